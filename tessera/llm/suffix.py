"""Suffix-array dedup: suffixes sorted by the difference cover {1, 2} modulo 3, then adjacent prefixes compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Units, contexts, merged, pairs, prepared, repeats, with_spans
from .common import mix64

#: Bytes of a repeat at least, and bytes of an anchor.
WINDOW, SEED = 200, 48
#: Bits of one name where three fit one integer.
NAME_BITS = 21
#: A fixed 64-bit number for each byte, which hashes are made of.
BYTE_NUMBERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def byte_units(window: int = WINDOW, seed: int = SEED) -> Units:
    return Units(seed, window, _bytes, lambda b: BYTE_NUMBERS[np.frombuffer(b, dtype=np.uint8)], bytes)


def _order(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of tuples, and whether each in that order differs from the one before."""
    if max((int(p.max(initial=0)) for p in parts), default=0) < 1 << NAME_BITS:
        key = parts[0].astype(np.int64)
        for p in parts[1:]:
            key = (key << NAME_BITS) | p
        order = np.argsort(key)
        key = key[order]
        return order, np.r_[True, key[1:] != key[:-1]][: len(key)]
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for p in parts:
        new[1:] |= p[order[1:]] != p[order[:-1]]
    return order, new


def _less(table: tuple[np.ndarray, ...], wanted: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many tuples of a sorted table are less than each wanted one; none is equal."""
    n = len(table[0])
    if max((int(p.max(initial=0)) for p in (*table, *wanted)), default=0) < 1 << NAME_BITS:
        a, b = table[0].astype(np.int64), wanted[0].astype(np.int64)
        for x, y in zip(table[1:], wanted[1:], strict=True):
            a, b = (a << NAME_BITS) | x, (b << NAME_BITS) | y
        return np.searchsorted(a, b)
    order, _ = _order(*(np.concatenate(x) for x in zip(table, wanted, strict=True)))
    before = np.cumsum(order < n)
    out = np.empty(len(wanted[0]), dtype=np.int64)
    mine = order >= n
    out[order[mine] - n] = before[mine]
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers over 0) in sorted order.

    Suffixes at places 1 and 2 modulo 3 are named by their first three symbols; unless the names tell
    all apart, the string of names is sorted the same way. The other suffixes sort by their symbol and
    the rank of what follows, and each sample suffix counts those that are less than it.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.zeros(n + 3, dtype=np.int64)
    t[:n] = s
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.r_[one, two]
    order, new = _order(t[sample], t[sample + 1], t[sample + 2])
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        # a name of 0 between the halves, so that no suffix of the first runs into the second
        halves = suffix_array(np.r_[names[: len(one)] + 1, 1, names[len(one) :] + 1])
        halves = halves[halves != len(one)]
        order = halves - (halves > len(one))
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    by_sample = sample[order]
    zero = zero[_order(t[zero], rank[zero + 1])[0]]
    first = by_sample % 3 == 1
    less = np.empty(len(sample), dtype=np.int64)
    a, b = by_sample[first], by_sample[~first]
    less[first] = _less((t[zero], rank[zero + 1]), (t[a], rank[a + 1]))
    less[~first] = _less((t[zero], t[zero + 1], rank[zero + 2]), (t[b], t[b + 1], rank[b + 2]))
    out = np.full(n, -1, dtype=np.int64)
    out[np.arange(len(sample)) + less] = by_sample
    out[out < 0] = zero
    return out


def adjacent_repeats(window: int):
    """Resolver of anchors.repeats(): starts of windows that another start of the same block shares.

    The contexts of a block stand one after the other with a zero between. Of its suffixes in sorted
    order, the ones that begin a window are kept; equal windows are neighbours among them.
    """

    def resolve(keys, before, after, texts) -> Iterator[tuple[int, int, int]]:
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        raw = np.frombuffer(b"\0".join(texts) + b"\0" * 9, dtype=np.uint8)
        symbols = raw[: len(raw) - 8].astype(np.int64) + 2
        symbols[starts[1:] - 1] = symbols[-1] = 1
        windows = sizes - window + 1
        begins = np.zeros(len(symbols), dtype=bool)
        at = np.repeat(starts - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
        begins[at] = True
        found = suffix_array(symbols)
        found = found[begins[found]]
        # eight bytes from each place on, to compare prefixes eight bytes at a time
        eight = np.zeros(len(raw) - 7, dtype=np.uint64)
        for i in range(8):
            eight |= raw[i : len(raw) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
        a, b = found[:-1], found[1:]
        for off in [*range(0, window - 7, 8), window - 8]:
            same = eight[a + off] == eight[b + off]
            a, b = a[same], b[same]
        again = np.zeros(len(symbols) + 1, dtype=bool)
        again[a] = again[b] = True
        edge = np.flatnonzero(again[1:] != again[:-1]) + 1
        if again[0]:
            edge = np.r_[0, edge]
        firsts, lasts = edge[::2], edge[1::2] - 1
        which = np.searchsorted(starts, firsts, side="right") - 1
        for i, first, last in zip(which.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            yield i, first - int(starts[i]), last - int(starts[i]) + window

    return resolve


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_spans_out: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_spans_out adds
    removed, the maximal removed runs as an array of start and end.

    A byte goes if a string of `window` bytes that covers it starts anywhere else as well, in another
    document or in the same one. Only suffixes whose first `window` bytes have an anchor that occurs
    twice can be such, so only those are sorted, each block of anchors for itself.
    Null or empty text: no bytes, the digest of the empty string. Texts under a window keep all. Rows
    that repeat id and text are one document, not two, and get equal rows; rows that share only the id,
    or have none, are documents of their own. Other columns are ignored; an empty table gives an empty
    result. Texts of any length are taken whole.
    """
    units = byte_units(window, seed)
    rows = prepared(docs)
    spans = repeats(contexts(rows, units, False), units, adjacent_repeats(window), later_only=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, at, kept, gone = _bytes(text), 0, hashlib.sha256(), merged(pairs(found))
                for start, end in gone:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                spots = [{"start": x, "end": y} for x, y in gone] if with_spans_out else None
                out.append((len(raw), sum(y - x for x, y in gone), len(gone), kept.hexdigest(), spots))
            columns = list(zip(*out, strict=True)) or [()] * 5
            spot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spot]
            made = [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            yield pa.RecordBatch.from_arrays(made[: 5 + with_spans_out], names=names[: 5 + with_spans_out])

    return with_spans(rows, spans).mapInArrow(
        finish, SCHEMA + ", removed array<struct<start: int, end: int>>" * with_spans_out
    )
