"""Substring and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import anchors
from tessera.llm.common import words
from tessera.llm.substring import substring_dedup
from tessera.llm.suffix import suffix_array, suffix_dedup

from .conftest import odd_texts, prose


def documents(rows):
    """Distinct (doc_id, text) in the operators' order; ties of an id are kept apart."""
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def brute_words(rows, window):
    docs, seen, out = documents(rows), set(), {}
    for d, t in docs:
        ws = words(t)
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[d, t] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(rows, window):
    docs, counts, out = documents(rows), {}, {}
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            counts[b[i : i + window]] = counts.get(b[i : i + window], 0) + 1
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - window + 1):
            if counts[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, found, want):
    got = sorted((str(r.doc_id), tuple(r)[1:]) for r in found.collect())
    assert got == sorted((str(r[0]), want[r[0], r[1]]) for r in rows)


def test_odd_rows(spark, odd):
    rows = odd_texts()
    check(spark, rows, substring_dedup(odd), brute_words(rows, 20))
    check(spark, rows, suffix_dedup(odd), brute_bytes(rows, 200))


def test_empty_table(none):
    assert substring_dedup(none).collect() == suffix_dedup(none).collect() == []


def mixed(seed):
    """Documents made of a few shared pieces, so that repeats begin, end and overlap anywhere."""
    r = random.Random(seed)
    pieces = [prose(i, r.randint(3, 40)) for i in range(8)] + ["a " * 60, "tick tock " * 20]
    return [(i, " ".join(r.choice(pieces) for _ in range(r.randint(1, 6)))) for i in range(60)]


@pytest.mark.parametrize("hot", [4000, 3])
def test_mixed_pieces(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)  # with 3, nearly all anchors count as frequent
    monkeypatch.setattr(anchors, "GROUP_BYTES", 2000)
    rows = mixed(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(spark, rows, substring_dedup(docs), brute_words(rows, 20))
    check(spark, rows, suffix_dedup(docs), brute_bytes(rows, 200))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(xs):
    assert suffix_array(np.array(xs, dtype=np.int64)).tolist() == sorted(range(len(xs)), key=lambda i: xs[i:])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=80), st.lists(st.integers(0, 3), max_size=9))
def test_equal_windows_have_equal_anchors(xs, before):
    """What stands before a window does not change its anchor."""
    def of_windows(units):
        h, c, place, first, last = anchors.winnow(np.array(units, dtype=np.uint64), 3, 8)
        return {s: (int(a), int(p - s)) for a, p, f, z in zip(h, place, first, last, strict=True) for s in range(f, z + 1)}

    plain, moved = of_windows(xs), of_windows([*before, *xs])
    assert all(moved[s + len(before)] == plain[s] for s in plain) and len(plain) == len(xs) - 7
