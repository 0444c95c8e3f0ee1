"""Each operator against brute force, and on awkward tables."""

import random

import numpy as np
import pytest

from stratum.llm import anchors, ann, automata, jaccard, licenses, mixing, packing, pq, quality, suffixes, toxicity
from stratum.llm.anchors import owned
from stratum.llm.common import ngram_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def words(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def awkward():
    """Copies, near copies, shared passages, nulls in every column, empty and long texts, repeated rows."""
    base = [words(rng.randint(60, 200)) for _ in range(12)]
    passage = words(70)
    texts = [" ".join(b) for b in base]
    texts += [texts[0], texts[1]]
    near = list(base[2])
    near[5], near[50] = "changed", "words"
    texts.append(" ".join(near))
    texts += [" ".join(words(30) + passage + words(20)), " ".join(passage + words(40)), "\n".join([" ".join(words(25)), " ".join(passage)])]
    texts += ["", None, "one", "two words", "same same " * 120, " ".join(words(5000)) + " " + " ".join(passage)]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, texts[3], None, None, None))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng.seed(5)
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    return docs


CLASHING = "doc fp key anchors start row take bucket sid cut cuts rows root stays kept src s last left i n first full copy unit d f __doc __fp __mix_key a.b".split()


def kept_apart(found):
    """Whether the clashing columns came back as they were."""
    return all(all(r[c] == c for c in CLASHING) for r in found)


def repeated(rows, k=50):
    """Spans by brute force: {(doc, text): covered words}, and those of later occurrences."""
    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = {}
    for d, t in distinct:
        w = t.split()
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append((d, t, i))
    every, spans = {}, []
    for places in at.values():
        if len({p[0] for p in places}) > 1:
            for d, t, i in places:
                every.setdefault((d, t), set()).update(range(i, i + k))
    for (d, _), covered in every.items():
        c = sorted(covered)
        first = c[0]
        for a, b in zip(c, [*c[1:], None], strict=True):
            if b != a + 1:
                spans.append((d, first, a + 1))
                first = b
    return sorted(spans, key=str)


def test_repeats_by_both_methods(docs, rows):
    want = repeated(rows)
    assert len(want) > 5
    for found in (suffixes.repeats(clashing(docs)), automata.located(clashing(docs))):
        assert sorted([(r.doc_id, r.start_word, r.end_word) for r in found.collect()], key=str) == want


def test_repeats_keep_one_occurrence(spark, docs, rows):
    found = suffixes.drop_repeats(clashing(docs)).collect()
    assert kept_apart(found)
    left = [r.text for r in found]
    passage = next(r[1] for r in rows if r[0] == 16).split()[:70]
    assert sum(" ".join(passage) in " ".join((t or "").split()) for t in left) == 1
    again = suffixes.repeats(suffixes.drop_repeats(docs))
    assert again.where("doc_id <> 0").count() == 0
    assert None in left and "" in left and "one" in left


def test_repeats_among_texts_without_an_id(spark):
    r = random.Random(8)
    own = [" ".join(r.choice(VOCAB) for _ in range(30)) for _ in range(3)]
    passage = " ".join(r.choice(VOCAB) for _ in range(60))
    texts = [f"{own[0]} {passage}", f"{own[1]} {passage}", f"{own[2]} {own[0]}"]
    df = spark.createDataFrame([(None, t) for t in [*texts, texts[2] + " " + own[1]] + texts[2:]], "doc_id long, text string")
    shared = [(None, 0, 60), (None, 0, 60), (None, 30, 90), (None, 30, 90)]
    for found in (suffixes.repeats(df), automata.located(df)):
        assert sorted((x.doc_id, x.start_word, x.end_word) for x in found.collect()) == shared
    alike = spark.createDataFrame([(None, texts[0])] * 2, "doc_id long, text string")
    assert suffixes.repeats(alike).count() == automata.located(alike).count() == 0


def test_hot_passages_are_told_where_they_lie(spark):
    """Passages that most documents have, over many batches of a task; rows alike, rows of one id, the least document last."""
    hot, long = [f"h{i}" for i in range(55)], [f"l{i}" for i in range(90)]
    r = np.random.default_rng(5)
    rows = []
    for i in range(4500, 0, -1):
        own = [f"w{x}" for x in r.integers(0, 10**6, 8)]
        rows.append((i % 4000, " ".join(own[:3] + hot + own[3:] + (long if i % 3 == 0 else []))))
    rows += rows[:50] + [(None, rows[7][1]), (None, " ".join(long)), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = repeated(rows)
    got = suffixes.repeats(df).collect()
    assert sorted([(x.doc_id, x.start_word, x.end_word) for x in got], key=str) == want and len(got) > 4000
    # rows without an id come first, so theirs are the first occurrences; a few windows go on into a word that two documents share by chance
    assert all(x.dup_words == 0 for x in got if x.doc_id is None)
    short = [x for x in got if x.doc_id is not None and x.dup_words < x.end_word - x.start_word]
    assert len(short) < 60 and all(x.dup_words == x.end_word - x.start_word - 1 for x in short)
    holders = {}
    for d, t in {(d, t) for d, t in rows if d is not None}:
        w = t.split()
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(d)
    lead = {min(h) for p, h in holders.items() if len(h) > 1 and p[0] + p[-1] not in ("h0h49", "h1h50", "h2h51", "h3h52", "h4h53", "h5h54") and p[0][0] + p[-1][0] != "ll"}
    assert {x.doc_id for x in short} <= lead
    assert sorted([(x.doc_id, x.start_word, x.end_word) for x in automata.located(df).collect()], key=str) == want


def test_known_keys_keep_the_least_and_another():
    r = np.random.default_rng(2)
    n = 4000
    keys, who, at = r.integers(0, 60, n).astype(np.uint64), r.integers(0, 300, n), r.integers(0, 40, n)
    keys[n // 2 :] = np.where(r.random(n - n // 2) < 0.5, np.uint64(7), keys[n // 2 :])
    keys[:3], who[:3] = 99, 4  # one document only
    sent, told, dropped, known = [], [], [], anchors.Known()
    for lo in range(0, n, 150):
        s = slice(lo, lo + 150)
        spare, again = known.surplus(keys[s], who[s], who[s], at[s])
        for k, w, a, x, y in zip(keys[s].tolist(), who[s].tolist(), at[s].tolist(), spare, again, strict=True):
            (told if x else dropped if y else sent).append((k, w, a))
    every = list(zip(keys.tolist(), who.tolist(), at.tolist(), strict=True))
    least = {k: min(x for x in every if x[0] == k) for k in set(keys.tolist())}
    several = {k for k in least if len({w for q, w, _ in every if q == k}) > 1}
    assert not any(x == least[x[0]] for x in told) and all(k in several for k, _, _ in told)
    for k in least:
        mine = [x for x in sent if x[0] == k]
        assert least[k] in mine and (len({w for _, w, _ in mine}) > 1) == (k in several)
    assert all(x in sent for x in dropped) and sum(k == 7 for k, _, _ in sent) < 40 < sum(k == 7 for k, _, _ in every)


def test_repeats_of_nothing(none):
    assert suffixes.repeats(none).count() == automata.located(none).count() == suffixes.drop_repeats(none).count() == 0


def test_collection_is_the_sorted_suffixes():
    r = np.random.default_rng(1)
    sizes = np.array([7, 1, 12, 7, 30])
    symbols = r.integers(1, 4, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    bwt, lcp, text, length = suffixes.collection(symbols, starts, sizes)

    def suffix(i, n):
        return [*symbols[starts[i] + sizes[i] - n : starts[i] + sizes[i]].tolist(), -1000 + int(i)]

    order = sorted(((suffix(i, n), i, n) for i in range(5) for n in range(sizes[i] + 1)))
    assert [(i, n) for _, i, n in order] == list(zip(text.tolist(), length.tolist(), strict=True))
    for k in range(1, len(order)):
        a, b = order[k - 1][0], order[k][0]
        same = next(j for j in range(len(a)) if a[j] != b[j])
        assert lcp[k] == same
    for k, (_, i, n) in enumerate(order):
        assert bwt[k] == (symbols[starts[i] + sizes[i] - n - 1] if n < sizes[i] else 0)


def test_anchor_depends_on_the_window_alone():
    r = np.random.default_rng(2)
    shared = r.integers(1, 2**60, 80).astype(np.uint64)
    seen = []
    for _ in range(3):
        h = np.concatenate([r.integers(1, 2**60, 33).astype(np.uint64), shared, r.integers(1, 2**60, 20).astype(np.uint64)])
        anchor, first, last = owned(h, np.array([len(h)]))
        starts = np.concatenate([np.full(b - a + 1, x) for x, a, b in zip(anchor, first, last, strict=True)])
        assert len(starts) == len(h) - 49
        seen.append(starts[33 : 33 + 31])
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all()


def test_ngram_hashes_are_local():
    h = np.arange(1, 60, dtype=np.uint64)
    for k in (1, 3, 20):
        g = ngram_hashes(h, k)
        assert len(g) == len(h) - k + 1 and len(set(g.tolist())) == len(g)
        assert ngram_hashes(h[7 : 7 + k], k)[0] == g[7]


def grams(t, n=3):
    w = (t or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(rows, n=3, threshold=0.5):
    """(doc_id, class_id, links) of every document with grams, by brute force."""
    nodes = [(d, grams(t, n)) for d, t in sorted({(r[0], r[1]) for r in rows}, key=str)]
    nodes = [(d, x) for d, x in nodes if x]
    near = [[j for j, (_, y) in enumerate(nodes) if i != j and len(x & y) >= threshold * len(x | y) - 1e-9] for i, (_, x) in enumerate(nodes)]
    root = list(range(len(nodes)))
    for _ in nodes:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(nodes))]
    named = {}
    for (d, _), r in zip(nodes, root, strict=True):
        named[r] = min((x for x in (named.get(r), d) if x is not None), default=None)
    return sorted([(d, named[r], len(near[i])) for i, ((d, _), r) in enumerate(zip(nodes, root, strict=True))], key=str)


def found_classes(df, **options):
    return sorted([(r.doc_id, r.class_id, r.links) for r in jaccard.near_classes(df, **options).collect()], key=str)


def test_jaccard_classes(docs, rows):
    want = classes(rows)
    assert sum(n for _, _, n in want) >= 8 and found_classes(clashing(docs)) == want


def edited(r, base, share):
    return [f"e{r.randint(0, 5000)}" if r.random() < share else w for w in base]


def test_jaccard_misses_nothing(spark):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"t{r.randint(0, 5000)}" for _ in range(r.randint(300, 2500))]
        texts += [" ".join(edited(r, base, share)) for share in (0, 0.02, 0.04, 0.09, 0.12)]
    tiny = ["a b c d", "a b c d e", "a b c", "a b", "b a", "a b c d e f", "x a b c d"]
    rows = list(enumerate(texts + tiny))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.5, 0.7):
        want = classes(rows, threshold=threshold)
        assert sum(n for _, _, n in want) > 30 and found_classes(df, threshold=threshold) == want


def test_jaccard_of_large_groups_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(edited(r, base, 0.06))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    assert max(n for _, _, n in want) > 50
    assert found_classes(df) == want
    monkeypatch.setattr(jaccard, "MOST", 900)
    assert found_classes(df) == want


def test_jaccard_counts_long_texts_exactly():
    r = random.Random(6)
    base = [f"t{r.randint(0, 9000)}" for _ in range(120_000)]
    texts = [" ".join(base), " ".join(edited(r, base, 0.02))]
    import pyarrow as pa

    from stratum.llm.common import Hashes

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [x for rows, sizes, g in jaccard._sets(batch, Hashes(), 3) for x in np.split(g, np.cumsum(sizes)[:-1])]
    assert len(np.intersect1d(*got)) == len(grams(texts[0]) & grams(texts[1])) and [len(x) for x in got] == [len(grams(t)) for t in texts]
    width = np.unique(np.concatenate(got), return_inverse=True)
    at = np.array([0, len(got[0]), len(got[0]) + len(got[1])])
    assert [(a.tolist(), b.tolist()) for a, b in jaccard.compare(np.array([0, 1]), np.empty(0, np.int64), at, width[1], len(width[0]), 0.5)] == [([0], [1])]


def test_tokens_alike_are_told_apart():
    row, bucket, token, most = jaccard._numbered(np.array([1, 0, 1, 1]), np.array([2, 2, 2, 2]), np.array([7, 7, 7, 7], np.uint32), np.array([3, 4, 5, 6], np.uint8))
    assert row.tolist() == [0, 1, 1, 1] and token[0] == token[1] == 7 and len(set(token[1:].tolist())) == 3


def test_near_documents_leave_one(docs, rows, none):
    left = jaccard.drop_near(clashing(docs)).collect()
    ids = [r.doc_id for r in left]
    assert 12 not in ids and 13 not in ids and 14 not in ids and ids.count(0) == 1
    # a text without doc_id sorts first and stands for its group
    assert None in ids and 3 not in ids
    assert {18, 19, 20, 21} <= set(ids)
    assert left[0].__fields__ == clashing(docs).columns and kept_apart(left)
    assert jaccard.drop_near(none).count() == jaccard.near_classes(none).count() == 0


def test_groups_are_connected(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    roots = dict(jaccard.components(edges).collect())
    assert all(roots[i] == 0 for i in range(41)) and roots[100] == roots[101] == roots[102] == 100


def mixed(rows, total=None):
    """Words per source that the plan may give."""
    out = {}
    for r in rows:
        out[r[3]] = out.get(r[3], 0) + len((r[1] or "").split())
    return out


def test_mixing_meets_budgets_exactly(docs, rows, none):
    have = mixed(rows)
    budget = sum(have.values()) // sum(v > 0 for v in have.values())
    plan = mixing.mix_plan(clashing(docs)).groupBy("source").sum("take_tokens").collect()
    assert {r[0]: r[1] for r in plan} == dict.fromkeys([s for s, v in have.items() if v], budget)
    out = mixing.mix_documents(clashing(docs)).collect()
    assert kept_apart(out)
    got = {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert got == dict.fromkeys([s for s, v in have.items() if v], budget)
    assert mixing.mix_plan(none).count() == mixing.mix_documents(none).count() == 0


def test_mixing_by_weights_and_ties(spark):
    rows = [(1, "a b c", "x")] * 5 + [(2, "d e", "y"), (3, "", "z"), (4, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r[0]: r[1] for r in mixing.mix_plan(df, {"x": 1.0, "y": 3.0}, 28).groupBy("source").sum("take_tokens").collect()}
    assert plan == {"x": 7, "y": 21, "z": 0}
    out = mixing.mix_documents(df, {"x": 1.0, "y": 3.0}, 28).collect()
    assert sum(len((r.text or "").split()) for r in out if r.source == "x") == 7
    assert sum(len((r.text or "").split()) for r in out if r.source == "y") == 21
    assert sum(r.source == "z" for r in out) == 2
    with pytest.raises(ValueError):
        mixing.budgets(df.selectExpr("source", "1L AS n_tokens"), {"x": -1.0})


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_is_a_partition_of_all_words(docs, rows, none):
    length = 64
    got = packing.pack(clashing(docs), length).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r.n_tokens for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.seq_id, []).append((r.seq_offset, r.n_tokens))
    assert sorted(by) == list(range(-(-total // length)))
    for seq, parts in by.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == (length if seq < max(by) else total - length * max(by))
    stretches = {}
    for r in got:
        stretches.setdefault(r.doc_id, []).append((r.doc_offset, r.n_tokens))
    long_ = sorted(stretches[23])
    assert long_[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(long_, long_[1:], strict=False))
    assert packing.pack(none).count() == 0


def naive_packing(rows, length, dims=packing.DIMS, bits=packing.BITS):
    """(seq_id, seq_offset, doc_id, doc_offset, n_tokens), a word at a time."""
    import xxhash

    def signed(word):
        h = xxhash.xxh3_64_intdigest(word)
        return [bin((h >> 8 * i) & 255).count("1") - 4 for i in range(dims)]

    vectors = []
    for r in rows:
        w = (r[1] or "").encode().split()
        if w:
            points = [signed(x) for x in w]
            vectors.append((r, len(w), [int(np.rint(sum(p[i] for p in points) * packing.SCALE / len(w))) for i in range(dims)]))
    v = np.array([x[2] for x in vectors], float)
    mean, top = v.mean(0), (1 << bits) - 1
    spread = np.sqrt(np.maximum((v**2).mean(0) - mean**2, 1.0))
    cells = np.clip(((v - mean) / spread + 4) / 8 * top, 0, top).astype(np.int64)
    key = packing.hilbert(cells, bits)
    return vectors, key


def test_packing_by_a_naive_packer(spark, docs, rows):
    length = 100
    vectors, key = naive_packing(rows, length)
    got = packing.pack(docs, length).collect()
    # which rows come in which order: by key, then doc_id (null first), then the text's hash
    hashes = {r.text: r.fp for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS fp").collect()}
    order = sorted(range(len(vectors)), key=lambda i: (key[i], -(2**63) if vectors[i][0][0] is None else vectors[i][0][0], hashes[vectors[i][0][1]]))
    want, at = [], 0
    for i in order:
        row, n, _ = vectors[i]
        for seq in range(at // length, (at + n - 1) // length + 1):
            lo, hi = max(at, seq * length), min(at + n, (seq + 1) * length)
            want.append((seq, lo - seq * length, row[0], lo - at, hi - lo))
        at += n
    assert sorted([(r.seq_id, r.seq_offset, r.doc_id, r.doc_offset, r.n_tokens) for r in got], key=str) == sorted(want, key=str)


def test_copies_are_neighbours_on_the_curve(docs):
    order = packing.curve_order(docs).orderBy("part", "key", "doc", "fp").collect()
    place = {r.doc: i for i, r in enumerate(order)}
    assert abs(place[1] - place[13]) == 1


LICENSED = [
    (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore text"),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."),
    (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
    (4, "A licence is not a license, and a warranty is no joke."),
    (5, "See the GNU General Public License for more details."),
    (6, ""),
    (7, None),
    (None, "Released under the MIT License."),
    (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore text"),
    (8, "word " * 30000 + ".\nRELEASED under  the MIT license!"),
]


def test_licenses(spark):
    df = spark.createDataFrame(LICENSED, "doc_id long, text string")
    got = sorted([(r.doc_id, r.license, r.n_matches) for r in licenses.license_scan(clashing(df)).collect()], key=str)
    want = [(1, "Apache-2.0", 1), (2, "MIT", 1), (3, "CC-BY-NC-4.0", 1), (3, "MIT", 1), (5, "UNKNOWN", 1), (8, "MIT", 1), (None, "MIT", 1)]
    assert got == sorted(want, key=str)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_every_known_sentence_has_a_hint_and_a_rule():
    for group in licenses.SENTENCES.values():
        for s in group:
            assert any(h in s for h in licenses.HINTS) and s == " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    assert {x for _, ids in licenses.RULES for x in ids} <= set(licenses.SENTENCES)


#: How texts write the known sentences that have an end mark inside; the others have none but the last.
WORDINGS = {
    "spdx license identifier": "SPDX-License-Identifier: ",
    "this program is free software you": "This program is free software: you",
    "without any warranty without": "WITHOUT ANY WARRANTY; without",
    "mozilla public license v 2 0": "Mozilla Public\nLicense, v. 2.0",
    "1 redistributions": "1. Redistributions",
    "2 redistributions": "2. Redistributions",
    "3 neither": "3. Neither",
    "copyright all rights": "Copyright. All rights",
}


def worded(sentence):
    for known, wording in WORDINGS.items():
        sentence = sentence.replace(known, wording)
    return f"Some words.\n\n{sentence}.\n\nMore words."


def test_every_known_sentence_is_found_in_its_wording(spark):
    every = [(s, k) for k, group in licenses.SENTENCES.items() for s in group]
    df = spark.createDataFrame([(i, worded(s)) for i, (s, _) in enumerate(every)], "doc_id long, text string")
    got = {r.doc_id: r.seq for r in licenses.identified(df).where("split = 'block'").collect()}
    assert got == {i: f"<{k}>" for i, (_, k) in enumerate(every)}


NOTICE = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_licenses_of_standard_notices(spark):
    texts = [NOTICE.format(":", ",", 3), NOTICE.format(";", ";", 2), MPL, "# SPDX-License-Identifier: MIT\nimport os\n", "License: released under the MIT License; see below", "a SPDX-License-Identifier: MIT\nSPDX-License-Identifier:\n\nMIT"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.n_matches) for r in got) == [(0, "GPL-3.0-or-later", 1), (1, "GPL-2.0-or-later", 1), (2, "MPL-2.0", 1), (3, "MIT", 1), (4, "MIT", 1)]


def test_licenses_of_wrapped_hints(spark):
    texts = [f"This is free and unencumbered software released into the public{gap}domain." for gap in (" ", "\n", "  ", "\r\n# ", "-")]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.n_matches) for r in got) == [(i, "Unlicense", 1) for i in range(len(texts))]


def labelled(spark):
    r = random.Random(11)
    stems = ["grobian", "lumpatz"]
    rows, labels = [], []
    for i in range(600):
        toxic, junk = i % 5 == 0, i % 7 == 0
        w = [r.choice(VOCAB) + r.choice("abcdefgh") * 2 for _ in range(r.randint(20, 300))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(stems) + r.choice(["", "er", "ig", "s", "ung", "lich"])
        if junk:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_unseen_spellings(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels.where("doc_id < 450"))
    truth = {r.doc_id: r.toxic == 1 for r in labels.where("doc_id >= 450").collect()}
    rejected = {r.doc_id for r in toxicity.toxic_documents(docs, labels.where("doc_id < 450")).collect()}
    right = sum(truth[d] == (d in rejected) for d in truth)
    assert right >= 0.95 * len(truth)
    scores = toxicity.text_logits(["w1aa w2bb lumpatzereien w3cc w4dd", "w1aa w2bb w5ee w3cc w4dd", "", None, "123"], toxicity.Scores(model.weights)) + model.bias - model.threshold
    assert scores[0] > 0 > scores[1] and (scores[2:] < 0).all()
    # a single word in a very long text
    assert toxicity.text_logits(["w1aa " + "w2bb w3cc " * 60000 + "grobian w1aa"], toxicity.Scores(model.weights))[0] + model.bias - model.threshold > 0


def test_toxicity_without_labels_rejects_nothing(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxic_documents(docs, labels).count() == 0
    assert toxicity.drop_toxic(clashing(docs), labels).count() == docs.count()
    assert toxicity.drop_toxic(none, labels).count() == toxicity.toxic_documents(none, labels.limit(0)).count() == 0


def test_quality_on_held_out_documents(spark, docs, none):
    all_docs, labels = labelled(spark)
    kept = {r.doc_id for r in quality.select_quality(clashing(all_docs), labels.where("doc_id < 450")).collect()}
    truth = {r.doc_id: r.quality == 1 for r in labels.where("doc_id >= 450").collect()}
    assert sum(truth[d] == (d in kept) for d in truth) >= 0.98 * len(truth)
    graded = quality.graded(docs, labels)
    assert graded.count() == docs.count() and graded.where("expected_grade < 0 OR expected_grade > 2 OR p_clean > p_sound").count() == 0
    assert quality.graded(none, labels).count() == 0
    for unable, grade in ((labels.limit(0), 0), (labels.selectExpr("doc_id", "0 AS quality", "toxic"), 0), (labels.selectExpr("doc_id", "1 AS quality", "0 AS toxic"), 2)):
        every = quality.select_quality(docs, unable).collect()
        assert len(every) == docs.count() and all(abs(r.expected_grade - grade) < 1e-6 for r in every)


def test_quality_by_a_plain_scorer(spark, docs):
    """The vectorised scores against the definition, for given weights."""
    r = np.random.default_rng(21)
    model = quality.Model(r.normal(size=quality.BUCKETS).astype(np.float32), np.array([-0.3, 0.4]))

    def plain(text):
        w = (text or "").encode().split()
        total = sum(float(model.weights[b]) for x in w for b in quality.word_features(x)) + sum(a == b for a, b in zip(w, w[1:], strict=False)) * float(model.weights[quality.REPEAT])
        z = total / len(w) if w else 0.0
        tails = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        return sum(tails), *tails

    got = sorted([(str(x.doc_id), x.expected_grade, x.p_sound, x.p_clean) for x in quality._graded(model, docs).collect()])
    want = sorted([(str(x.doc_id), *plain(x.text)) for x in docs.collect()])
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want])
    assert quality.word_features(b"Abc-12x")[1] == quality.word_features(b"Zzzyy-9q")[1] != quality.word_features(b"abc-12x")[1]


def test_toxicity_by_a_plain_scorer():
    """The vectorised logits against the definition, for given weights."""
    import xxhash

    r = np.random.default_rng(22)
    weights = r.normal(size=toxicity.BUCKETS).astype(np.float32)

    def buckets(word):
        """Character n-grams by a rolling hash, and the word itself."""
        mask, out = (1 << 64) - 1, []
        code = [ord(c) * 0x9E3779B97F4A7C15 & mask for c in f"<{word}>"]
        for n in toxicity.NGRAMS:
            for i in range(len(code) - n + 1):
                h = code[i]
                for k in range(1, n):
                    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + code[i + k]) & mask
                h = (h ^ (h >> 32)) * 0x94D049BB133111EB & mask
                out.append((h >> 20) % toxicity.BUCKETS)
        return [*out, xxhash.xxh3_64_intdigest(word) % toxicity.BUCKETS]

    def plain(text):
        words = toxicity.LETTERS.findall((text or "").lower())
        words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
        scores = [float(np.mean(weights[buckets(w)])) for w in words]
        n = min(toxicity.WINDOW, len(scores))
        return max((sum(scores[i : i + n]) / n for i in range(len(scores) - n + 1)), default=toxicity.NEVER) if n else toxicity.NEVER

    texts = ["Ein Wort", "a", "", None, "12 !", "so so so viele Wörter hier, und noch mehr davon", " ".join(words(300)), "ÄÖÜ straße " * 4]
    assert np.allclose(toxicity.text_logits(texts, toxicity.Scores(weights)), [plain(t) for t in texts], atol=1e-5)


def test_labelled_sample_is_bounded_before_it_travels(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, ["toxic"], 10).values.tolist() == [[1, "a", 1], [2, "c", 0]]


def test_ordinal_gradient_orders_thresholds():
    r = np.random.default_rng(4)
    level = r.integers(0, 4, 800)
    texts = [" ".join(["good"] * int(k) + ["bad"] * int(3 - k) + [f"x{r.integers(50)}" for _ in range(5)]) for k in level]
    model = quality.fit(texts, level)
    assert (np.diff(model.thresholds) > 0).all()
    memo = quality.Weights(model.weights)
    z = np.array([quality.text_score(t.encode(), memo) for t in texts])
    assert (quality.probabilities(z, model.thresholds).argmax(1) == level).mean() > 0.95


def vectors(spark, n=600, dims=32):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, dims)) + 1.5 * r.normal(size=(6, dims))[r.integers(0, 6, n)]
    x[100:110] = x[0] + r.normal(0, 0.01, (10, dims))
    x[110] = x[0] * 3
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(x)]
    bad = [(n, None, "", ""), (None, x[0].tolist(), "", ""), (n + 1, [0.0] * dims, "", ""), (n + 2, [float("nan")] * dims, "", ""), (n + 3, [1.0], "", ""), (n + 4, [], "", "")]
    return x, spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>, id string, v string")


def exact_neighbours(x, queries, k=10):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u[queries] @ u.T
    s[np.arange(len(queries)), queries] = -9
    return s, np.sort(s, axis=1)[:, -k]


def test_nearest_neighbours(spark):
    x, df = vectors(spark)
    s, _ = exact_neighbours(x, np.arange(len(x)))
    want = np.argsort(-s, axis=1)[:, :10]
    got = {}
    for r in ann.neighbours(df, every=1).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
        assert abs(r.cosine - s[r.vec_id, r.neighbour_id]) < 1e-9
    assert set(got) == set(range(len(x)))
    recall = np.mean([len(set(got[i]) & set(want[i].tolist())) / 10 for i in range(len(x))])
    assert recall >= 0.9
    assert {r.vec_id for r in ann.neighbours(df).collect()} == set(range(0, len(x), 100))
    assert ann.neighbours(df.limit(0)).count() == 0 and ann.neighbours(df.where("vec_id = 1"), every=1).count() == 0
    assert ann.neighbours(df.where("vec_id < 3"), every=1).count() == 6
    with pytest.raises(TypeError):
        ann.neighbours(df.selectExpr("concat('a', vec_id) AS vec_id", "embedding"))


@pytest.mark.parametrize("structured", [True, False])
def test_isolated_vectors_have_all_neighbours(spark, structured):
    r = np.random.default_rng(9)
    alone, dims = 24, 32
    groups = np.repeat(r.normal(size=(50, dims)), 24, axis=0) if structured else r.normal(size=(3000, dims))
    x = np.concatenate([groups + 0.001 * r.normal(size=groups.shape), r.normal(size=(alone, dims))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    every = 1 if structured else 20
    queries = np.arange(0, len(x), every)
    _, least = exact_neighbours(x, queries)
    got = {}
    for row in ann.neighbours(df, every=every).collect():
        got.setdefault(row.vec_id, []).append((row.rank, row.neighbour_id, row.cosine))
    recall = []
    for i, low in zip(queries.tolist(), least, strict=True):
        assert sorted(rank for rank, _, _ in got[i]) == list(range(1, 11)) and len({j for _, j, _ in got[i]}) == 10
        recall.append(np.mean([c >= low - 1e-9 for _, _, c in got[i]]))
    assert np.mean(recall) >= 0.9
    if structured:
        assert np.mean(recall[-alone:]) >= 0.9 and min(recall) >= 0.5


def test_index_returns_every_code_in_the_radius():
    r = np.random.default_rng(3)
    block = r.integers(0, 256, (500, 4), dtype=np.uint8)
    index = ann.Postings(block)
    for radius in (0, 3, 9, 14, 32):
        for q in [*block[:10], *r.integers(0, 256, (10, 4), dtype=np.uint8)]:
            assert index.within(q, radius).tolist() == np.flatnonzero(ann.distances(block, q) <= radius).tolist()


def vector_classes(x, ids, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold - 1e-9
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        low = np.minimum(root, np.where(near, root[None], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            return {i: (int(c), int(n)) for i, c, n in zip(ids, root, near.sum(1), strict=True)}
        root = low


def found_vectors(df, threshold=0.95):
    rows = pq.near_classes(df, threshold).collect()
    got = {r.vec_id: (r.class_id, r.links) for r in rows}
    assert len(got) == len(rows)
    return got


def test_near_vectors_misses_nothing(spark):
    x, df = vectors(spark)
    for t in (0.95, 0.7):
        want = vector_classes(x, list(range(len(x))), t)
        assert sum(n for _, n in want.values()) >= 110 and found_vectors(df, t) == want
    assert pq.near_classes(df.limit(0)).count() == 0
    assert found_vectors(df.where("vec_id = 1")) == {1: (1, 0)}


def test_near_vectors_of_hot_groups_and_copies(spark, monkeypatch):
    """A third are near copies of one vector, a third are the same vector; lists are split into blocks."""
    monkeypatch.setattr(pq, "BLOCK", 64)
    r = np.random.default_rng(12)
    x = r.normal(size=(900, 64)).astype(np.float32)
    x[:300] = x[0] + r.normal(0, 0.1, (300, 64))
    x[300:600] = x[300]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = vector_classes(x.astype(np.float64), list(range(900)), 0.95)
    assert want[0] == (0, 299) and want[301] == (300, 299) and found_vectors(df) == want


def test_near_vectors_without_structure(spark):
    """64 independent directions, where probes are fewer than would be needed in the worst case; pairs at the very threshold."""
    r = np.random.default_rng(13)
    base = r.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=(1000, 64))
    side -= (side * base[:1000]).sum(1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = 0.951
    x = np.concatenate([base, cosine * base[:1000] + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = vector_classes(x, list(range(len(x))), 0.95)
    got = found_vectors(df)
    links = sum(n for _, n in want.values())
    assert links >= 2000 and all(got[i][1] <= want[i][1] for i in want) and sum(n for _, n in got.values()) >= 0.999 * links
