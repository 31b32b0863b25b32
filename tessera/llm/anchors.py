"""Seeds for repeats over a length: winnowed anchors, the join on them, and the contexts around shared ones.

A text is a sequence of units (words or bytes). Of each window of `window` consecutive units, the k-unit
gram with the least hash (the leftmost of equals) is the anchor. Equal windows have equal anchors at equal
offsets, so windows can only be equal if their anchors share a hash; every window belongs to one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mix64

#: Odd base of the polynomial hash over units; its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Low bits of a compared value that hold the position: units of one chunk of a long text.
PLACE_BITS = 24
#: An anchor with more occurrences is dealt by its own hash and half a window more on either side.
HOT = 4000
#: Bytes of contexts that are resolved together, or a key's if those are more.
GROUP_BYTES = 2_500_000

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * len(known) if known is not None else 4096)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = known = np.multiply.accumulate(factors)
    return known[:n]


def prefix_sums(units: np.ndarray) -> np.ndarray:
    sums = np.empty(len(units) + 1, dtype=np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(units)), out=sums[1:])
    return sums


def slice_hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, inverse: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[end] - sums[start]) * inverse)


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return slice_hashes(prefix_sums(units), slice(0, -k), slice(k, None), powers(INVERSE, n))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def winnow(units: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of a text, by place: hash, hash of its context, place, first and last window start.

    The context is all that the anchor's windows cover; its hash tells its extent from the anchor too.
    """
    n = len(units) - window + 1
    if n <= 0:
        return (*(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(3)))
    sums, inverse, w = prefix_sums(units), powers(INVERSE, len(units)), window - k + 1
    grams = slice_hashes(sums, slice(0, -k), slice(k, None), inverse[: len(units) - k + 1])  # as gram_hashes()
    chosen = np.empty(n, dtype=np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - w
    for at in range(0, n, step):
        part = grams[at : at + step + w - 1]
        marked = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        chosen[at : at + step] = (sliding_least(marked, w) & low).astype(np.int64) + at
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    place, last = chosen[first], np.r_[first[1:] - 1, n - 1]
    context = slice_hashes(sums, first, last + window, inverse[first])
    with np.errstate(over="ignore"):
        extent = ((place - first) * 65536 + (place - last)).astype(np.uint64)
        context = mix64(context + extent * np.uint64(BASE))
    return grams[place], context, place, first, last


@dataclass(frozen=True)
class Units:
    """How a text is cut: split gives its units as bytes or words, number turns them into integers,
    join makes a slice of them bytes again."""

    k: int
    window: int
    split: Callable[[str | None], object]
    number: Callable[[object], np.ndarray]
    join: Callable[[object], bytes]


def named(docs: DataFrame) -> DataFrame:
    """doc, t, text: a document is its id and the hash of its text, so that rows that share an id or
    have none stay apart; a row that repeats both is the same document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"), "text")


def anchor_rows(docs: DataFrame, units: Units) -> DataFrame:
    """h, c, doc, t, place, before, after: an anchor's hash and its context's, and how many units before
    its place its windows begin at most and at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [winnow(units.number(units.split(x)), units.k, units.window) for x in b.column(2).to_pylist()]
            if not found:
                continue
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            h, c, place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(c.view(np.int64)),
                    b.column(0).take(rows),
                    b.column(1).take(rows),
                    pa.array(place.astype(np.int32)),
                    pa.array((place - first).astype(np.int16)),
                    pa.array((place - last).astype(np.int16)),
                ],
                names=["h", "c", "doc", "t", "place", "before", "after"],
            )

    return docs.mapInArrow(run, "h long, c long, doc long, t long, place int, before short, after short")


CONTEXT = "key long, doc long, t long, start int, end int, before short, context binary"


def contexts(docs: DataFrame, units: Units, later_only: bool) -> DataFrame:
    """key, doc, t, start, end, before, context of anchors that other contexts share.

    context: units start to end, from the start of an anchor's first window to the end of its last;
    the anchor is `before` units into it. Where an anchor's context has occurred as a whole (by the
    hashes of anchor and context, 128 bits together), its units are known to be repeated: without
    later_only in all occurrences, with it in all but the first. A row without context names such
    units. Texts are fetched only for the first occurrence of a context, and only if its anchor has
    another context too. Contexts of a frequent anchor are dealt by the anchor and half a window beyond
    it, once for the windows that reach that far to the right and once for the others, which reach as
    far to the left.
    """
    order = [F.col("doc").asc_nulls_first(), F.col("t"), F.col("place")]
    anchors = anchor_rows(docs, units)
    by_anchor, by_context = Window.partitionBy("h"), Window.partitionBy("h", "c")
    ranked = (
        # places are ranked, not rows: a row that repeats a row of the table is no further occurrence
        anchors.withColumn("nth", F.dense_rank().over(by_context.orderBy(*order)))
        .withColumn("copies", F.lit(2) if later_only else F.max("nth").over(by_context))
        .withColumn("least", F.min("c").over(by_anchor))
        .withColumn("most", F.max("c").over(by_anchor))
        .withColumn("n", F.count("*").over(by_anchor))
    )
    whole = (F.col("nth") > 1) if later_only else (F.col("copies") > 1)
    open_ = (F.col("nth") == 1) & (F.col("least") != F.col("most"))
    places = (
        ranked.where(whole | open_)
        .groupBy("doc", "t")
        .agg(F.collect_list(F.struct(whole.alias("whole"), open_.alias("open"), "h", "n", "place", "before", "after")).alias("places"))
    )
    texts = docs.join(
        places.hint("shuffle_hash"), docs.doc.eqNullSafe(places.doc) & (docs.t == places.t)
    ).select(docs.doc, docs.t, "text", "places")
    over = units.window - units.k
    right = over // 2  # units beyond the anchor that a window of the right kind has at least
    left = over - right + 1
    fields = [x.split()[0] for x in CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, t, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = units.split(text)
                known = [(x["place"] - x["before"], x["place"] - x["after"] + units.window) for x in found if x["whole"]]
                for x in found:
                    if not x["open"]:
                        continue
                    h, p = x["h"], x["place"]
                    if x["n"] <= HOT:
                        kinds = [(h, x["before"], x["after"])]
                    else:
                        kinds = []
                        if x["after"] < left:
                            beyond = units.join(cut[p : p + units.k + right])
                            kinds.append((xxhash.xxh64_intdigest(beyond, 1), min(x["before"], left - 1), x["after"]))
                        if x["before"] >= left:
                            beyond = units.join(cut[p - left : p + units.k])
                            kinds.append((xxhash.xxh64_intdigest(beyond, 2), x["before"], max(x["after"], left)))
                    for key, before, after in kinds:
                        start, end = p - before, p - after + units.window
                        key = (key + (1 << 63)) % (1 << 64) - (1 << 63)
                        out.append((key, doc, t, start, end, before, units.join(cut[start:end])))
                out += [(t, doc, t, start, end, 0, None) for start, end in merged(known)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.binary()]
            for at in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + 20_000], k) for c, k in zip(columns, kinds, strict=True)], names=fields
                )

    return texts.mapInArrow(run, CONTEXT)


#: Takes key, before, after and context of distinct contexts, groups together and earlier occurrences
#: first, and gives rows (index, first start, end) of what is repeated, in units from the context's start.
Resolve = Callable[[list[int], list[int], list[int], list[bytes]], Iterator[tuple[int, int, int]]]


def repeats(found: DataFrame, units: Units, resolve: Resolve, later_only: bool) -> DataFrame:
    """doc, t, start, end of units that lie in repeated windows, from contexts().

    Rows of a key stream by in the order of doc and place. Of equal contexts only the first is held, so
    a large group of copies takes no memory; with later_only the first of them isn't itself repeated
    for that.
    """
    window = units.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of distinct contexts
        size = 0
        twice: set[int] = set()
        seen: dict[tuple, int] = {}
        spans: list[tuple] = []

        def flush() -> None:
            if held:
                keys, docs, ts, starts, ends, before, texts = zip(*held, strict=True)
                spans.extend((docs[i], ts[i], starts[i], ends[i]) for i in twice)
                after = [b - (e - s - window) for s, e, b in zip(starts, ends, before, strict=True)]
                spans.extend(
                    (docs[i], ts[i], starts[i] + a, starts[i] + e) for i, a, e in resolve(keys, before, after, texts)
                )
            held.clear()
            twice.clear()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*spans, strict=True)) or [()] * 4
            spans.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "t", "start", "end"]
            )

        last = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, doc, t, start, end, before, context = row
                if context is None:
                    spans.append((doc, t, start, end))
                    continue
                if key != last:
                    seen.clear()
                    last = key
                    if size > GROUP_BYTES:
                        flush()
                        size = 0
                i = seen.get((context, before))
                if i is None:
                    seen[context, before] = len(held)
                    held.append(row)
                    size += len(context) + 100
                elif held[i][1:4] != (doc, t, start):  # else a repeated row of the table
                    spans.append((doc, t, start, end))
                    if not later_only:
                        twice.add(i)
            if len(spans) > 50_000:
                yield rows()
        flush()
        yield rows()

    dealt = found.repartition("key").sortWithinPartitions("key", F.col("doc").asc_nulls_first(), "t", "start")
    return dealt.mapInArrow(run, "doc long, t long, start int, end int")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, text, spans (array of start, end; null where there is none) of every row of named docs."""
    lists = spans.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(
        lists.hint("shuffle_hash"), docs.doc.eqNullSafe(lists.doc) & (docs.t == lists.t), "left"
    ).select(docs.doc, "text", "spans")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pairs(spans: list[dict] | None) -> Iterator[tuple[int, int]]:
    return ((x["start"], x["end"]) for x in spans or ())


def prepared(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return named(docs)
