"""Texts in pieces, and columns through buckets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import common, jaccard


@pytest.fixture(scope="module")
def batch():
    r = random.Random(1)
    texts = [" ".join(f"w{r.randint(0, 50)}" for _ in range(r.choice([0, 1, 2, 5, 30, 77, 333]))) for _ in range(600)] + [None]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc", "text"])


@pytest.mark.parametrize("overlap", [0, 2, 49])
@pytest.mark.parametrize("most", [60, 100, 10**6])
def test_every_window_is_in_one_piece(batch, overlap, most):
    seen = {}
    for lists, rows, starts in common.pieces(batch, overlap, most):
        for w, row, start in zip(lists, rows, starts, strict=True):
            for k in range(len(w) - overlap):
                seen.setdefault(row, []).append((start + k, tuple(w[k : k + overlap + 1])))
    for i, t in enumerate(batch.column("text").to_pylist()):
        w = (t or "").encode().split()
        assert sorted(seen.get(i, [])) == [(k, tuple(w[k : k + overlap + 1])) for k in range(len(w) - overlap)]


def test_sets_do_not_depend_on_pieces(batch, monkeypatch):
    whole, found = common.pieces, []
    for most in (10**6, 50, 100):
        monkeypatch.setattr(jaccard, "pieces", lambda b, overlap, most=most: whole(b, overlap, most))
        got = {}
        for rows, sizes, grams in jaccard._sets(batch, common.Hashes(), 3):
            for row, at, n in zip(rows.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                got[row] = set(grams[at : at + n].tolist())
                assert len(got[row]) == n
        found.append(got)
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("planes", [False, True])
def test_packed_round_trip(planes):
    r = np.random.default_rng(0)
    size = r.integers(0, 6, 50)
    first = np.cumsum(size) - size
    values = r.integers(0, 2**32, size.sum()).astype(np.uint32)
    bucket, a = r.integers(0, 7, 50), np.arange(50)
    cells = common.packed(bucket, [a, size], 7, (values, first, size), planes=planes).column("payload").to_pylist()
    got_a, got_size, got_values = common.unpacked(cells, [np.int64, np.int64], np.uint32, planes=planes)
    at = np.cumsum(got_size) - got_size
    assert sorted(got_a.tolist()) == list(range(50))
    for i, x in enumerate(got_a):
        assert got_values[at[i] : at[i] + got_size[i]].tolist() == values[first[x] : first[x] + size[x]].tolist()
