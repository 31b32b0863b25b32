"""Order MinHash near-dedup: sketches of k-mers in text order, candidates verified by banded alignment."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import gram_hashes
from .common import bounded_batches, components, mix64, words, written_table
from .substring import word_numbers

SIMILARITY = 0.8
#: Words of a k-mer, and the least and most words of the texts that are sketched by it. Edits leave short texts no
#: long k-mers; the ranges overlap so that two texts of SIMILARITY always have a k in common.
KMERS = ((2, 5, 19), (3, 16, 124), (5, 100, 1 << 62))
#: k-mers of one sketch entry, and entries of a sketch.
TAKEN, ENTRIES = 2, 72
#: Hash values that stand in memory at once.
FLAT = 1 << 20
#: Words are counted by hash in so many places, to tell texts of other words apart without reading them: up to 255
#: in each of the few, up to 15 in each of the many, which the last round looks at where the few don't tell. Of the
#: many a text has about two a word, a power of two.
TALLIES, WIDE = 128, 4096
#: First rounds take one of so many parts of the entries, others in each round, and go on while one finds more than
#: one of so many parts of the most links of a round.
PORTION, WORTH = 4, 20
#: Documents that one task compares with each other: crowds beyond it are split.
CROWD = 1000
#: Parts of CROWD documents up to which those of crowded entries are compared all with all.
PARTS = 20
#: Documents of a key up to which pairs are given in the last round without looking at their other keys.
SMALL = 4
#: Ids up to which the documents of a later round's pairs are found by a broadcast of their ids (8 bytes each). The
#: first round's are in proportion to the corpus, so they are joined.
FEW = 50_000
#: Documents whose words are counted, and the most frequent of these that the driver holds: only an order of
#: the words, so neither changes the result.
COUNTED, FREQUENT = 20_000, 100_000
_MULTIPLIERS = mix64(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def labelled_kmers(numbers: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer with the number of its earlier occurrences, by place."""
    g = gram_hashes(numbers, k)
    if len(g) < 2:
        return g
    order = np.argsort(g, kind="stable")
    same = np.r_[False, g[order[1:]] == g[order[:-1]]]
    if not same.any():
        return g
    at = np.arange(len(g))
    nth = np.empty(len(g), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    again = nth > 0
    with np.errstate(over="ignore"):
        g[again] = mix64(g[again] + nth[again] * np.uint64(0xC2B2AE3D27D4EB4F))
    return g


def entries_of(g: np.ndarray) -> np.ndarray:
    """The entries of labelled k-mers by place, as hashes.

    Entry i takes the TAKEN labelled k-mers that are least under hash i and keeps the order in which
    they stand in the text, so two documents agree in it if they share those k-mers in that order.
    """
    out = np.empty(ENTRIES, dtype=np.uint64)
    at_once = max(1, FLAT // len(g))
    with np.errstate(over="ignore"):
        for e in range(0, ENTRIES, at_once):
            h = g[None, :] * _MULTIPLIERS[e : e + at_once, None]
            places = np.empty((len(h), min(TAKEN, len(g))), dtype=np.int64)
            for t in range(places.shape[1]):
                places[:, t] = h.argmin(axis=1)
                h[np.arange(len(h)), places[:, t]] = np.iinfo(np.uint64).max
            x = np.arange(e + 1, e + 1 + len(h), dtype=np.uint64)
            for column in np.sort(places, axis=1).T:
                x = mix64(x * np.uint64(0x9FB21C651E98DF25) + g[column])
            out[e : e + at_once] = x
    return out


def sketch(numbers: np.ndarray) -> np.ndarray:
    """The entries of a document as hashes, ENTRIES for each k whose range its number of words is in. Texts under
    five words have none: an edit of them is more than SIMILARITY allows."""
    found = [entries_of(labelled_kmers(numbers, k)) for k, least, most in KMERS if least <= len(numbers) <= most]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def tally(numbers: np.ndarray, places: int = TALLIES, most: int = 255) -> np.ndarray:
    counts = np.bincount((mix64(numbers) % np.uint64(places)).astype(np.int64), minlength=places)
    return np.minimum(counts, most).astype(np.uint8)


def wide_tally(numbers: np.ndarray) -> bytes:
    """tally() of up to WIDE places, two of them in a byte."""
    counts = tally(numbers, min(max(2 * TALLIES, 1 << (2 * len(numbers) - 1).bit_length()), WIDE), 15)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """Word edits between a and b, None if more than `most`: an alignment in the band of `most` diagonals to
    either side, a column of the band in one integer.

    Bit k of column j (from 1) stands for row j - most + k. rise and fall mark the rows whose distance is
    one more or less than the row's above, in the column before; level tells where a diagonal step costs
    nothing. The distance is followed down the band's last diagonal to the last row of a, then along it.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if n <= most:  # the band holds all rows: a common end, whose rows cost nothing, makes room
        end = [object()] * (most - n + 1)
        a, b = [*a, *end], [*b, *end]
        n, m = len(a), len(b)
    width = 2 * most + 1
    band = (1 << width) - 1
    rows: dict[Hashable, int] = {}
    for i, w in enumerate(a):
        rows[w] = rows.get(w, 0) | 1 << i
    rise, fall, far = band >> most << most, 0, most
    along = m - n + most  # columns after the last row is reached
    for j, w in enumerate(b, 1):
        down = j - most - 1
        same = rows.get(w, 0)
        same = (same >> down if down >= 0 else same << -down) & band
        level = ((((same & rise) + rise) ^ rise) | same | fall) & band
        up = fall | (band & ~(level | rise))
        back = level & rise
        if j + most <= n:
            far += not level >> (width - 1)
            if far - along > most:
                return None
        else:
            at = n - j + most
            far += (up >> at & 1) - (back >> at & 1)
        slid = level >> 1
        rise, fall = back | (band & ~(slid | up)), slid & up
    return far if far <= most else None


def edits_allowed(longer: int | np.ndarray, least: float = SIMILARITY) -> int | np.ndarray:
    """Word edits that two texts may differ in, by the words of the longer."""
    x = (1 - least) * longer + 1e-9
    return x.astype(np.int64) if isinstance(x, np.ndarray) else int(x)


def similar(a: list[bytes], b: list[bytes], least: float = SIMILARITY) -> bool:
    """Whether 1 - word edits / words of the longer text is at least `least`."""
    longer = max(len(a), len(b))
    most = edits_allowed(longer, least)
    if abs(len(a) - len(b)) > most:
        return False
    ids: dict[bytes, int] = {}
    x, y = ([ids.setdefault(w, len(ids)) for w in t] for t in (a, b))
    # words that both have bound the words that can be aligned
    both = np.minimum(np.bincount(x, minlength=len(ids)), np.bincount(y, minlength=len(ids))).sum()
    return bool(longer - both <= most) and edit_distance(x, y, most) is not None


SKETCHES = "id long, same binary, n int, tally binary, wide binary, entries array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document with words: id, digest of its words, number of words, tallies and sketch."""
    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ws := words(text):
                numbers = word_numbers(ws)
                same = xxhash.xxh128_digest(b" ".join(ws))
                rows.append((i, same, len(ws), tally(numbers).tobytes(), wide_tally(numbers), sketch(numbers).view(np.int64)))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = zip(*rows, strict=True) if rows else ((),) * 6
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "same", "n", "tally", "wide", "entries"])


def _close(at: int, others: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places `others` whose text that at `at`, of no fewer words, can be similar to, and how far their
    tallies are. An edit changes the counts of two texts and their numbers of words by two in all, and capped
    counts differ by less."""
    apart = np.abs(counts[others] - counts[at]).sum(axis=1, dtype=np.int64) + (n[at] - n[others])
    close = apart <= 2 * edits_allowed(int(n[at]))
    return others[close], apart[close]


class _Wide:
    """Wide tallies of a cell's rows, unpacked as they are asked for. Tallies of more places are folded to fewer, which
    brings them no further apart."""

    def __init__(self, packed: pa.ChunkedArray) -> None:
        self.packed, self.folded = packed, {}

    def of(self, places: np.ndarray) -> np.ndarray:
        most = min(2 * len(self.packed[k].as_py()) for k in (places[0], places[-1]))  # by words, the least first
        if most not in self.folded:
            self.folded[most] = np.zeros(len(self.packed), dtype=bool), np.empty((len(self.packed), most), dtype=np.int16)
        known, counts = self.folded[most]
        for k in places[~known[places]].tolist():
            pairs = np.frombuffer(self.packed[k].as_py(), dtype=np.uint8)
            counts[k] = np.stack([pairs & 15, pairs >> 4], axis=1).reshape(-1, most).sum(axis=0)
            known[k] = True
        return counts


def _compared(nth: int | None):
    """Pairs (a, b) from rows (cell, part, id, n, c, tally, wide, key, keys) by cell and n: all of different components
    that can be similar, each in the least key that both documents have, or in all where keys is null; with nth, of
    each document only the nth nearest of those with no more words, by tally."""

    def pairs_of(rows: pa.Table) -> Iterator[np.ndarray]:
        cells = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(cells)], strict=True):
            own = rows.slice(lo, hi - lo)
            part, i, n, c = (own.column(x).to_numpy() for x in range(1, 5))
            if hi - lo < 2 or (c == c[0]).all():
                continue
            counts = np.frombuffer(b"".join(own.column(5).to_pylist()), dtype=np.uint8).reshape(-1, TALLIES).astype(np.int16)
            wide, parted = None, (part != part[0]).any()
            key, keys, told = own.column(7)[0].as_py(), {}, not own.column(8).null_count
            first = np.searchsorted(n, SIMILARITY * n - 1e-9)
            for at in range(1, hi - lo):
                others = np.arange(first[at], at)[c[first[at] : at] != c[at]]
                if parted:  # texts of one part meet where no other part is
                    others = others[part[others] != part[at]]
                others, apart = _close(at, others, n, counts)
                if not len(others):
                    continue
                if nth is not None:
                    others = others[np.argsort(apart, kind="stable")][min(nth, len(others) - 1)][None]
                else:
                    wide = wide or _Wide(own.column(6))
                    others, _ = _close(at, others, n, wide.of(np.r_[others, at]))
                    if not len(others):
                        continue
                    if told:
                        for k in (at, *others.tolist()):
                            if k not in keys:
                                keys[k] = frozenset(own.column(8)[k].as_py())
                        others = others[[min(keys[at] & keys[k], default=key) >= key for k in others.tolist()]]
                yield np.stack([np.minimum(i[others], i[at]), np.maximum(i[others], i[at])])

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for x in pairs_of(rows):
            out.append(x)
            size += x.shape[1]
            if size > FLAT:
                yield flushed(out)
                out, size = [], 0
        if out:
            yield flushed(out)

    def flushed(out: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            cell = b.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell waits for what follows
            if held and held[-1].column(0)[-1].as_py() != cell[0]:
                yield from found(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from found(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _pairs(rows: DataFrame, tallies: DataFrame, nth: int | None, whole: bool = False) -> DataFrame:
    """Pairs (a, b) of documents of rows (key, id, n, c, m) that share a key, m being the key's rows.

    A key of up to CROWD rows is one cell; with whole, all are. A larger one is cut into parts by a hash of the id:
    with nth each part is a cell of its own, by another hash each time; without it any two parts make a cell, so that
    all pairs meet. Its rows carry the document's lesser keys, to tell in which key it meets another first; those of
    keys of up to SMALL documents, most of all and few pairs each, don't, and such a pair can be found several times.
    """
    parts = F.ceil(F.col("m") / CROWD).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(-1 if nth is None else nth)), parts).cast("int")
    wide = (F.lit(None).cast("binary") if nth is not None else F.col("wide")).alias("wide")
    keys = F.lit(None).cast("array<long>")
    if nth is None:
        many = rows.where(F.col("m") > SMALL).groupBy("id", "n").agg(F.collect_set("key").alias("keys"))
        tallies = tallies.join(many, ["id", "n"], "left")
        keys = F.when(F.col("m") > SMALL, F.filter("keys", lambda x: x < F.col("key")))
    rows = rows.select("key", "id", "n", "c", "m", parts.alias("parts"), part.alias("part"))
    if whole:
        low, high, part = F.lit(0), F.lit(0), F.lit(0)
    elif nth is None:
        # a part meets itself in the first cell, with part 0 for all, and each other part in one
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        rows = rows.select("*", other)
        low, high = F.least("part", "other"), F.greatest("part", "other")
        part = F.when(F.col("part") == F.col("other"), 0).otherwise(F.col("part") + 1)
    else:
        low, high, part = F.col("part"), F.col("part"), F.lit(0)
    rows = rows.select(F.xxhash64("key", low, high).alias("cell"), part.alias("part"), "id", "n", "c", "key", "m")
    dealt = rows.join(tallies, ["id", "n"]).select("cell", "part", "id", "n", "c", "tally", wide, "key", keys.alias("keys"))
    return dealt.repartition("cell").sortWithinPartitions("cell", "n", "id").mapInArrow(_compared(nth), "a long, b long").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [labelled_kmers(word_numbers(words(x)), 1) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["word"])


def rare_words(numbers: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rarest labelled words of a document, as many as every text of SIMILARITY shares one of.

    Texts of m <= n words and up to d = (1 - SIMILARITY) n edits share n - d labelled words or more. In any order
    of all words that holds for both texts, the first d + 1 of the longer and the first m - n + d + 1 of the shorter
    have one in common; both are (1 - SIMILARITY) of their words, rounded down, and one, at most.
    frequent: sorted, others come first.
    """
    g = labelled_kmers(numbers, 1)
    rank = np.zeros(len(g), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        rank = np.where(frequent[at] == g, ranks[at], 0)
    return g[np.lexsort((g, rank))[: edits_allowed(len(numbers)) + 1]]


def _rare(frequent: np.ndarray, ranks: np.ndarray):
    """Rows (key, id, n, c) of the rarest words of documents (id, c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = [word_numbers(words(x)) for x in b.column(2).to_pylist()]
            keys = [rare_words(x, frequent, ranks) for x in numbers]
            counts = [len(x) for x in keys]
            ids, owners = (np.repeat(b.column(x).to_numpy(), counts) for x in (0, 1))
            sizes = np.repeat(np.array([len(x) for x in numbers], dtype=np.int32), counts)
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids, sizes, owners)], names=["key", "id", "n", "c"])

    return run


def _by_rare_words(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (key, id, n, c) of the documents (id, c) of crowded entries: those that can be similar share a key."""
    read = written_table(docs.join(crowd.hint("shuffle_hash"), "id").select("id", "c", "text"), "crowd")
    parts = -(-read.count() // COUNTED)
    some = read.where(F.pmod(F.xxhash64("id"), F.lit(max(1, parts))) == 0).select("text")
    counts = some.mapInArrow(_counted, "word long").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    frequent, ranks = (top.column(x).to_numpy() for x in range(2))
    frequent = frequent.view(np.uint64)
    order = np.argsort(frequent)
    return read.mapInArrow(_rare(frequent[order], ranks[order]), "key long, id long, n int, c long")


def _crowd_rows(crowd: DataFrame, tallies: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (key, id, n, c, m) of the documents (id, c) of crowded entries, for all pairs that share a key: one key for
    all where that makes up to PARTS parts and no more rows than their rarest words do, else a key for each of these."""
    one = written_table(crowd.join(tallies.select("id", "n"), "id"), "crowd")
    m, rare = one.agg(F.count("*"), F.sum(F.floor(F.col("n") * (1 - SIMILARITY) + 1e-9) + 1)).first()
    parts = -(-m // CROWD)
    if parts <= PARTS and m * parts <= rare:
        return one.select(F.lit(0).cast("long").alias("key"), "id", "n", "c", F.lit(m).cast("long").alias("m"))
    return _live(_by_rare_words(crowd, docs))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        keep = [x == y or similar(words(x), words(y)) for x, y in texts]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, docs: DataFrame, first: bool = False) -> DataFrame:
    """Those of pairs (a, b) whose texts are similar."""
    pairs = written_table(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if not first and ids.limit(FEW + 1).count() <= FEW:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    left, right = (docs.select(F.col("id").alias(x), F.col("text").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    both = right.join(left.join(pairs.hint("shuffle_hash"), "a").hint("shuffle_hash"), "b").select("a", "b", "x", "y")
    return written_table(both.mapInArrow(_verified, "a long, b long"), "near")


def _live(placed: DataFrame) -> DataFrame:
    """Of rows (key, id, n, c) those whose key has several components, with the key's rows as m."""
    sizes = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"))
    # as a table, so that the join can split the rows of a hot key
    sizes = written_table(sizes.where("lo < hi").select("key", "m"), "live")
    return placed.join(sizes, "key").select("key", "id", "n", "c", "m")


def groups(docs: DataFrame) -> DataFrame:
    """Rows (id, component) of documents that belong to a group of near copies with others, where component
    is the smallest id of the group.

    Two documents are near copies if 1 - word edits / words of the longer is SIMILARITY or more. Documents
    of equal words are grouped by digest, and the one of the smallest id stands for them. Others meet in the
    entries of their sketches; pairs that meet and whose tallies allow it are verified by banded alignment. Groups
    are the connected components.

    First rounds compare each document with one of another component in some of the entries, until a round finds few
    links; they only save work, as two of one component need no comparing after. The last round takes every pair
    of different components that shares an entry: in entries of up to CROWD documents directly, those of larger ones
    all with all, or by their rarest words, of which near copies share one (see rare_words()), whichever is less. No task compares more than about
    2 CROWD documents, and none is left out for standing in a crowd.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    sketches = written_table(rows.mapInArrow(_sketched, SKETCHES), "sketches")
    least = sketches.groupBy("same").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    least = written_table(least.select("same", "a"), "classes")
    copies = written_table(sketches.select("same", F.col("id").alias("b")).join(least, "same").select("a", "b"), "copies")
    # an id that stands for no class of its own is compared through the one that does
    gone = copies.groupBy(F.col("b").alias("id")).agg(F.max(F.col("a") == F.col("b")).alias("stands"), F.count("*").alias("n"))
    texts = sketches.groupBy("id").agg(F.count("*").alias("texts"))
    gone = gone.where("not stands").join(texts, "id").where("n = texts").select("id")
    entries = sketches.select(F.explode("entries").alias("key"), "id", "n")
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    shared = written_table(shared, "shared")
    met = written_table(entries.join(shared, "key").join(written_table(gone, "gone"), "id", "left_anti"), "entries")
    tallies = sketches.select("id", "n", "tally", "wide")
    links = copies.where("a != b")
    found = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    nth = most = 0
    while True:
        placed = met.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        met = written_table(_live(placed), "entries")  # an entry of one component stays one
        some = met.where(F.pmod(F.xxhash64("key", F.lit(nth)), F.lit(PORTION)) == 0)
        near = _links(_pairs(some, tallies, nth), rows, nth == 0)
        n = near.count()
        links = links.union(near)
        most = max(most, n)
        if n * WORTH <= most:  # few links are left, and the last round finds them all
            break
        found = components(links)
        nth += 1
    crowd = met.where(F.col("m") > CROWD).select("id", "c").distinct()
    pairs = _pairs(met.where(F.col("m") <= CROWD), tallies, None, whole=True)
    if not crowd.isEmpty():
        pairs = pairs.union(_pairs(_crowd_rows(crowd, tallies, rows), tallies, None)).distinct()
    return components(links.union(_links(pairs, rows)))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id of its group of near copies, its own if
    it has none), kept (doc_id = component_id).

    See groups() for the similarity. Null texts, texts without words and rows without doc_id belong to no
    group and are kept. Rows that repeat an id are one document with several texts: they share a group
    and get equal rows. Other columns are ignored. An empty table gives an empty result. Texts of any
    length are compared whole.
    """
    found = written_table(groups(docs), "groups")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .join(found.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a near copy of a smaller doc_id in their group."""
    go = groups(docs).where("id != component").select("id")
    return docs.join(go.hint("shuffle_hash"), docs["doc_id"].cast("long") == go["id"], "left_anti")
