"""Embedding near-dedup with spherical-cap filters: product codes list-decode a vector to its filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, written_table

#: A filter direction is the sum of one codeword of each block after a random rotation:
#: ROTATIONS * CODEWORDS ** BLOCKS filters. With these, two random vectors of 64 numbers whose cosine is
#: exactly 0.9 share a filter in all but about 1 of 2000 cases, nearer ones practically always (measured
#: in tests/llm). A larger corpus wants more codewords, so that filters stay small.
ROTATIONS, BLOCKS, CODEWORDS = 5, 4, 16
#: Inner product with a filter's unit direction, times the root of the dimension, from which a vector is in
#: it; a rotation in which a vector has fewer than LEAST such filters gives its LEAST best ones.
CAP, LEAST = 3.7, 8
SEED = 20240229
COSINE = 0.9
#: Below so many numbers caps leave out too many links (0.42 of pairs at the threshold met with 4 numbers, 0.62 with
#: 8), so such vectors are dealt by grid cells over up to AXES of them, which lose none.
FEW, AXES = 16, 6
#: Vectors of one filter that are compared in one task; larger filters are dealt in pairs of parts.
PART = 2000


@lru_cache(maxsize=40)
def code(dim: int, rotation: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation's matrix and the codewords of each block of coordinates, as rows."""
    rng = np.random.default_rng([SEED, dim, rotation])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out = []
    for n in np.diff(block_cuts(dim)):
        c = rng.standard_normal((CODEWORDS, n))
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / np.sqrt(BLOCKS))
    return turn, out


def block_cuts(dim: int) -> np.ndarray:
    return np.linspace(0, dim, BLOCKS + 1).astype(int)


def filters_of(x: np.ndarray) -> list[np.ndarray]:
    """Numbers of the filters that each unit row of x exceeds, ascending."""
    if x.shape[1] < FEW:
        return list(grid_cells(x))
    per = CODEWORDS**BLOCKS
    found = [[f + r * per for f in _exceeded(x, r)] for r in range(ROTATIONS)]
    return [np.concatenate(lists).astype(np.int32) for lists in zip(*found, strict=True)]


def grid_cells(x: np.ndarray) -> np.ndarray:
    """Numbers of the cells that hold each row, in every grid of cells two reaches wide, shifted by a reach or not
    along each axis; ascending. Vectors whose cosine is COSINE are a reach apart at most, so along each axis one of
    the two grids has both in one cell, and one of all grids has both in one."""
    axes = min(x.shape[1], AXES)
    reach = np.sqrt(2 - 2 * COSINE) + 1e-6
    # numbers are from -1 to 1, so with or without a shift there are up to 4 cells on an axis
    at = np.stack([np.floor((np.clip(x[:, :axes], -1, 1) + 1 + shift * reach) / (2 * reach)).astype(np.int32) for shift in (0, 1)])
    out = np.empty((len(x), 1 << axes), dtype=np.int32)
    for grid in range(1 << axes):
        number = np.full(len(x), grid, dtype=np.int32)
        for axis in range(axes):
            number = number * 4 + at[grid >> axis & 1, :, axis]
        out[:, grid] = number
    return out


def _exceeded(x: np.ndarray, rotation: int) -> list[np.ndarray]:
    """Codewords of two blocks at a time are summed; with both halves sorted, a partial sum is followed
    only as far as the best of the other half can lift it over the cap."""
    n, dim = x.shape
    turn, words = code(dim, rotation)
    cuts, x = block_cuts(dim), x @ turn
    s = [x[:, a:b] @ c.T for a, b, c in zip(cuts[:-1], cuts[1:], words, strict=True)]
    half = CODEWORDS**2
    head = (s[0][:, :, None] + s[1][:, None, :]).reshape(n, half)
    tail = (s[2][:, :, None] + s[3][:, None, :]).reshape(n, half)
    order = np.argsort(-tail, axis=1)
    cap = CAP / np.sqrt(dim)
    out = []
    for h, t, o in zip(head, tail, order, strict=True):
        down = -t[o]
        many = np.searchsorted(down, h - cap, side="right")
        total = int(many.sum())
        if total < LEAST:
            best = (h[:, None] + t[None, :]).ravel()
            found = np.argpartition(-best, LEAST - 1)[:LEAST]
        else:
            first = np.repeat(np.arange(half), many)
            nth = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            found = first * half + o[nth]
        out.append(np.sort(found))
    return out


def pack(x: list) -> bytes:
    """A vector as bytes: a mark, then single precision where that is exact, else double."""
    wide = np.array(x, dtype="<f8") + 0.0
    narrow = wide.astype("<f4")
    return b"f" + narrow.tobytes() if (narrow == wide).all() else b"d" + wide.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f4" if raw[:1] == b"f" else "<f8", offset=1).astype(np.float64)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([unpack(r) for r in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by_size: dict[int, list[int]] = {}
        vectors = b.column(2).to_pylist()
        for i, v in enumerate(vectors):
            by_size.setdefault(len(unpack(v)), []).append(i)
        for size, at in by_size.items():
            found = filters_of(_unit([vectors[i] for i in at]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(at)) for c in b.columns),
                    pa.array(list(found), pa.list_(pa.int32())),
                    pa.array([size] * len(at), pa.int32()),
                ],
                names=["id", "w", "v", "filters", "dim"],
            )


_KNOWN: dict[bytes, np.ndarray] = {}


def _filters_again(raw: list[bytes]) -> list[np.ndarray]:
    """filters_of() of packed vectors; a vector with links shows up in filter after filter."""
    if len(_KNOWN) > 20_000:
        _KNOWN.clear()
    new = [r for r in dict.fromkeys(raw) if r not in _KNOWN]
    if new:
        _KNOWN.update(zip(new, filters_of(_unit(new)), strict=True))
    return [_KNOWN[r] for r in raw]


def _links(ids, ws, raw, number: int, split: int, cosine: float):
    """Links of one part of a filter that no smaller filter has: rows (id, n, None), and (id, None, other)
    to tie linked vectors together. Rows from split on are another part: only pairs across count."""
    x = _unit(raw)
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    near = x[left] @ x[right].T >= cosine
    if not split:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    # a common filter with a smaller number takes the pair
    rows = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0)) + split
    member: dict[int, int] = {}
    marks = []
    for part in rows:
        at, cols = [], []
        for k, found in enumerate(_filters_again([raw[i] for i in part])):
            for f in found[: np.searchsorted(found, number)].tolist():
                at.append(k)
                cols.append(member.setdefault(f, len(member)))
        marks.append((at, cols, len(part)))
    dense = []
    for at, cols, n in marks:
        m = np.zeros((n, max(1, len(member))), dtype=np.float32)
        m[at, cols] = 1
        dense.append(m)
    near = near[np.ix_(rows[0], rows[1] - split)] & (dense[0] @ dense[1].T == 0)
    w = np.array(ws, dtype=np.int64)
    for k, i in enumerate(rows[0]):
        if n := int(w[rows[1]][near[k]].sum()):
            yield ids[i], n, None
    if split:
        for k, j in enumerate(rows[1]):
            if n := int(w[rows[0]][near[:, k]].sum()):
                yield ids[j], n, None
    # a tree over each linked set: every vector to the least one it links with, until nothing changes
    parent = {int(i): int(i) for i in np.r_[rows[0], rows[1]]}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(rows[0][k])), root(int(rows[1][j]))
        if a != b:
            a, b = (a, b) if ids[a] < ids[b] else (b, a)
            parent[b] = a
            yield ids[a], None, ids[b]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. Two rows link when the
    cosine in double precision is at least `cosine`. Equal vectors are compared once, with a weight.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do those
    of different lengths with each other. Rows without vec_id link with nothing and keep their row
    (component_id null, kept true). Rows that repeat a vec_id count as vectors of their own but share
    a node, so their links add up. An empty table gives an empty result.

    Vectors of FEW numbers or more meet in caps, which find all but about 1 of 300 links at the threshold itself
    (measured in tests/llm); shorter ones in cells, which find all.
    Filters are numbered; a pair that shares several counts in the first. A filter with more than PART
    vectors is cut into parts, and every two parts meet in a task of their own, so no task holds an
    unbounded group and only counts and trees leave it, never all pairs.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    number = F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(number, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long"), number.alias("e"), (fine & F.col("vec_id").isNotNull()).alias("fine"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [pack(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    valid = written_table(rows.where("fine").select("vec_id", "e").mapInArrow(packed, "vec_id long, v binary"), "vectors")
    classes = valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).select("id", "w", "v")
    decoded = written_table(
        classes.mapInArrow(_decode, "id long, w long, v binary, filters array<int>, dim int"), "filters"
    )
    # at most one row for each filter and dimension
    sizes = decoded.select("dim", F.explode("filters").alias("f")).groupBy("dim", "f").agg(F.count("*").alias("n"))
    sizes = sizes.where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    each = decoded.select("*", F.explode("filters").alias("f")).join(sizes.hint("merge"), ["dim", "f"])
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    dealt = each.withColumn("p", part).select(
        "id", "w", "v", "dim", "f", "p",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(
            F.least(q, F.col("p")).alias("a"), F.greatest(q, F.col("p")).alias("b")))).alias("cell"),
    )
    dealt = dealt.select("dim", "f", "cell.a", "cell.b", "p", "id", "w", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                (_, f, a, b), split = group[0][:4], 0
                if a != b:
                    split = sum(r[4] == a for r in group)
                    if split in (0, len(group)):
                        group.clear()
                        return
                ids, ws, raw = ([r[k] for r in group] for k in (5, 6, 7))
                out.extend(_links(ids, ws, raw, f, split, cosine))
            group.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "n", "other"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:4] != row[:4]:
                    close()
                group.append(row)
            if len(out) > 20_000:
                yield batch()
        close()
        yield batch()

    keys = ["dim", "f", "a", "b"]
    met = written_table(
        dealt.repartition(*keys).sortWithinPartitions(*keys, "p", "id").mapInArrow(meet, "id long, n long, other long"),
        "met",
    )
    counts = met.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    found = components(met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_class = (
        classes.join(counts, "id", "left")
        .join(found.select("id", "component"), "id", "left")
        .select(
            "v",
            (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    linked = valid.join(per_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: near_duplicates() over the table embeddings with ids that are neither null nor repeated.
LINKS_SQL = f"""
WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(l.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(l.m, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN least l ON l.a = v.vec_id
"""
