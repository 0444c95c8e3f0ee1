"""Frameworks: what they invoke by convention, which edges only they know, and what they make uncertain.

A plugin says whether its framework is there (from a few manifests, read once), and gives entry globs, edges over the graph's nodes, and taint rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import files


@dataclass(frozen=True)
class Entry:
    glob: str
    kind: str  # prod or test


@dataclass(frozen=True)
class Taint:
    pattern: str


@dataclass
class Repo:
    """What plugins may look at: declared dependencies, names in the root folder, the two manifests."""

    target: str
    dependencies: set[str]
    names: list[str]
    package: dict
    pyproject: str

    def depends(self, *names: str) -> bool:
        return any(n in self.dependencies for n in names)

    def configured(self, *globs: str) -> bool:
        known = [re.compile(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".")) for g in globs]
        return any(k.fullmatch(n) for n in self.names for k in known)

    def section(self, header: str) -> bool:
        return files.has_section(self.pyproject, header)

    @property
    def python_library(self) -> bool:
        """Built and installed elsewhere: what it exports may be used there."""
        return self.section("project") and self.section("build-system")

    @property
    def published(self) -> bool:
        return "name" in self.package and self.package.get("private") is not True


def repo(target: str) -> Repo:
    package, pyproject = files.read_json(target, "package.json"), files.read_text(target, "pyproject.toml") or ""
    named = [package.get(k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    dependencies = {n for group in named if isinstance(group, dict) for n in group}
    dependencies |= set(files.dependency_names(pyproject, files.read_text(target, "requirements.txt") or ""))
    return Repo(target, dependencies, files.root_names(target), package, pyproject)


class Plugin(Protocol):
    name: str

    def detect(self, repo: Repo) -> bool: ...

    def entries(self, repo: Repo) -> list[Entry]: ...

    def edges(self, repo: Repo, nodes: DataFrame) -> DataFrame | None:
        """src, dst, kind, or None for none."""

    def taints(self, repo: Repo) -> list[Taint]: ...


class Quiet:
    """A plugin that adds neither edges nor taints."""

    def edges(self, repo: Repo, nodes: DataFrame) -> DataFrame | None:
        return None

    def taints(self, repo: Repo) -> list[Taint]:
        return []


class Pytest(Quiet):
    name = "pytest"

    def detect(self, repo: Repo) -> bool:
        return repo.depends("pytest") or repo.configured("pytest.ini") or repo.section("tool.pytest.ini_options")

    def entries(self, repo: Repo) -> list[Entry]:
        return [Entry(g, "test") for g in ("**/test_*.py", "**/*_test.py", "**/tests/**")]


_CODE = "{ts,tsx,js,jsx,mjs}"
_ROUTES = "{page,layout,route,loading,error,template,default,not-found,global-error}"


class Nextjs(Quiet):
    name = "nextjs"

    def detect(self, repo: Repo) -> bool:
        return repo.depends("next") or repo.configured("next.config.*")

    def entries(self, repo: Repo) -> list[Entry]:
        below = (f"app/**/{_ROUTES}.{_CODE}", f"pages/**/*.{_CODE}", f"middleware.{_CODE}", f"instrumentation.{_CODE}")
        return [Entry(root + g, "prod") for g in below for root in ("", "src/")]


@dataclass
class TestConfig:
    """What a test runner's configuration names."""

    __test__ = False
    runner: str
    match: list[str] = field(default_factory=list)
    setup: list[str] = field(default_factory=list)
    around: list[str] = field(default_factory=list)
    configs: list[str] = field(default_factory=list)


_VITEST = [f"{stem}.config.{e}" for stem, ends in (("vitest", "ts mts cts js mjs cjs"), ("vite", "ts mts js mjs")) for e in ends.split()]
_JEST = [f"jest.config.{e}" for e in "ts js mjs cjs json".split()]
_SCRIPTS = "{js,jsx,ts,tsx}"
_JEST_MATCH = [f"**/__tests__/**/*.{_SCRIPTS}", f"**/*.{{spec,test}}.{_SCRIPTS}"]
_VITEST_MATCH = ["**/*.{test,spec}.{js,jsx,ts,tsx,mjs,mjsx,mts,mtsx,cjs,cjsx,cts,ctsx}"]


def array_literal(source: str, name: str) -> list[str]:
    """The string literals of the first `name: [...]` in a script."""
    m = re.search(rf"[\"']?{name}[\"']?\s*:\s*\[(.*?)\]", source, re.S)
    return [x.removeprefix("./") for x in re.findall(r"[\"'`]([^\"'`]+)[\"'`]", m[1])] if m else []


def _strings(value: object) -> list[str]:
    some = value if isinstance(value, list) else [value]
    return [x.removeprefix("./") for x in some if isinstance(x, str)]


def jest_options(found: TestConfig, options: object) -> None:
    if isinstance(options, dict):
        found.match += _strings(options.get("testMatch"))
        found.setup += _strings(options.get("setupFiles")) + _strings(options.get("setupFilesAfterEach"))
        found.around += _strings(options.get("globalSetup"))


def test_config(repo: Repo) -> TestConfig:
    """Read without running anything: array literals of the configuration file, or the package's own jest block; else the runner's usual globs."""
    if repo.depends("vitest") or repo.configured("vitest.config.*", "vite.config.*"):
        runner, names = "vitest", _VITEST
    elif repo.depends("jest", "@jest/core") or "jest" in repo.package or repo.configured("jest.config.*"):
        runner, names = "jest", _JEST
    else:
        runner, names = "unknown", []
    found = TestConfig(runner)
    config = next((n for n in names if n in repo.names), None)
    if config is not None:
        found.configs.append(config)
        text = files.read_text(repo.target, config) or ""
        if config.endswith(".json"):
            jest_options(found, files.read_json(repo.target, config))
        else:
            found.match += array_literal(text, "include" if runner == "vitest" else "testMatch")
            for key in ("setupFiles", *(["setupFilesAfterEach"] if runner == "jest" else [])):
                found.setup += array_literal(text, key)
            found.around += array_literal(text, "globalSetup")
    elif runner == "jest" and "jest" in repo.package:
        found.configs.append("package.json")
        jest_options(found, repo.package["jest"])
    found.match = found.match or (_JEST_MATCH if runner == "jest" else _VITEST_MATCH)
    return found


test_config.__test__ = False


def mock_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, kind: from each module to the file of its name in a `__mocks__` folder beside it, which test runners load in its place."""
    of = nodes.select("file").distinct()
    mocks = of.where(F.col("file").rlike(r"(^|/)__mocks__/[^/]+$")).select(F.col("file").alias("dst"), F.regexp_replace("file", r"(^|/)__mocks__/([^/]+)$", "$1$2").alias("real"))
    return mocks.join(of, F.col("real") == F.col("file")).select(F.col("file").alias("src"), "dst", F.lit("test").alias("kind"))


class TestRunner:
    __test__ = False
    name = "test-runner"

    def detect(self, repo: Repo) -> bool:
        return repo.depends("vitest", "jest", "@jest/core", "mocha", "@playwright/test") or repo.configured("vitest.config.*", "jest.config.*") or "jest" in repo.package

    def entries(self, repo: Repo) -> list[Entry]:
        c = test_config(repo)
        return [Entry(g, "test") for g in (*c.match, *c.setup, *c.around, *c.configs, "**/__mocks__/**")]

    def edges(self, repo: Repo, nodes: DataFrame) -> DataFrame | None:
        return mock_edges(nodes)

    def taints(self, repo: Repo) -> list[Taint]:
        return [Taint("jest.mock(<non-literal>)")]


ALL: list[Plugin] = [TestRunner(), Nextjs(), Pytest()]


def detected(repo: Repo, plugins: list[Plugin] | None = None) -> list[Plugin]:
    return [p for p in (ALL if plugins is None else plugins) if p.detect(repo)]
