"""Settings of an analysis: defaults, and a JSON file whose top-level keys replace and whose nested blocks merge key by key."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path

DEFAULTS: dict = {
    "include": ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mts", "**/*.cts", "**/*.py"],
    "ignore": [],
    "entries": [],
    "thresholds": {"nesting": 3, "cyclomatic": 10, "cognitive": 15, "loc": 50, "params": 5},
    "duplication": {"minTokens": 50},
    "hotspots": {"top": 10},
    "coverage": {"reports": ["coverage/lcov.info", "coverage.xml"]},
}


def load(path: str | Path | None) -> dict:
    """Defaults with the file's settings over them; a missing file is no error."""
    out = deepcopy(DEFAULTS)
    if path is None or not Path(path).exists():
        return out
    for k, v in json.loads(Path(path).read_text()).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def directory(target: str | Path) -> Path:
    """The folder that settings are looked for in: the target if it is one, else the one it is in."""
    p = Path(target)
    return p if p.is_dir() else p.parent
