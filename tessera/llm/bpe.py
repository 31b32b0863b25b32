"""BPE encoding and decoding with a public vocabulary, by merge rounds over flat numpy arrays."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Words of one task that stay in its cache; beyond that it starts anew.
CACHE_WORDS = 400_000
#: Symbols that one call of merge_rounds takes at once.
FLAT_SYMBOLS = 60_000
WORD_END = "</w>"
#: The white space that the vocabulary's patterns call \s, as a range list of code points.
WHITE_RANGES = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A)] + [
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)
]

#: Fixed values of the Unicode versions that the vocabulary's library goes by, as ranges of code points: letters and
#: numbers that unicodedata (15.1) doesn't know, letters and numbers of later versions that the library doesn't know,
#: and marks that its normal form neither reorders nor composes.
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
PLAIN_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Capitals of these versions, first and last, and the small letter of the first.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
SMALL = {a + i: small + i for a, b, small in CAPITALS for i in range(b - a + 1)}


def character_class(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def latin_class(major: str) -> list[tuple[int, int]]:
    return [(i, i) for i in range(256) if unicodedata.category(chr(i))[0] == major]


@lru_cache(maxsize=4)
def category_class(major: str) -> str:
    """Letters (L) or numbers (N) as the vocabulary's library knows them, whatever the version of unicodedata from
    15.1 on."""
    hit = np.array([unicodedata.category(chr(i))[0] == major for i in range(0x110000)], dtype=np.int8)
    for a, b in LATER:
        hit[a : b + 1] = 0
    for a, b in ADDED_LETTERS if major == "L" else ADDED_NUMBERS:
        hit[a : b + 1] = 1
    edge = np.flatnonzero(np.diff(np.r_[0, hit, 0]))
    return character_class(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is visible
    Latin-1, else the next free one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary of a tokenizers file: NFC, white space to one blank, lower case, then
    contractions, runs of letters, single digits and runs of other characters."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.final = np.array([vocab[c + WORD_END] for c in chars], dtype=np.int32)
        self.size = len(self.tokens)
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        _, first = np.unique(keys[::-1], return_index=True)  # of a repeated pair the last rank counts
        order = len(keys) - 1 - first
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32), order.astype(np.int32), made.astype(np.int32)
        self.none = np.int32(len(made))
        # A round may merge all places of a word's lowest pair unless what they make can merge at a lower rank.
        lowest = np.full(self.size, len(merges))
        for side in (left, right):
            np.minimum.at(lowest, side, np.arange(len(merges)))
        self.alone = lowest[made] < np.arange(len(merges))
        self.any_alone = bool(self.alone.any())
        white = character_class(WHITE_RANGES)
        split = f"'s|'t|'re|'ve|'m|'ll|'d|[{{0}}]+|[{{1}}]|[^{white}{{0}}{{1}}]+"
        self.pieces = regex.compile(split.format(r"\p{L}", r"\p{N}"))
        self.latin_pieces = re.compile(split.format(*(character_class(latin_class(x)) for x in "LN")))
        # long lists of ranges are slow, so they serve only texts with a character that regex counts otherwise
        letter, number = category_class("L"), category_class("N")
        self.newer = regex.compile(rf"(?V1)[[\p{{L}}~~[{letter}]][\p{{N}}~~[{number}]]]")
        capitals = character_class((a, b) for a, b, _ in CAPITALS)
        self.plain_marks = re.compile(f"([{character_class(PLAIN_MARKS)}])")
        self.late = re.compile(f"[{capitals}{character_class(PLAIN_MARKS)}]")
        self.exact_pieces = regex.compile(split.format(letter, number))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Special tokens and words of a text, in order; a special token keeps its own string.

        White space needs no replacing here: no word holds any. Latin-1 text is in normal form and has
        a short pattern of its own.
        """
        if "<|" not in text:
            return self.split_plain(text)
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.split_plain(part)
        return out

    def split_plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.late.search(text):
                # a mark that takes no part in the normal form parts what stands before and after it
                text = "".join(unicodedata.normalize("NFC", x) for x in self.plain_marks.split(text)).translate(SMALL)
            else:
                text = unicodedata.normalize("NFC", text)
            pieces = self.exact_pieces if self.newer.search(text) else self.pieces
            # lower case letter by letter: a capital sigma has one small form here wherever it stands
            return pieces.findall(text.replace("Σ", "σ").lower())
        return self.latin_pieces.findall(text.lower())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) * np.uint32(self.size) + right.astype(np.uint32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)

    def merge_rounds(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word (not empty), as little-endian unsigned 32-bit integers.

        Symbols of all words stand in one array; rank[i] is that of symbols i and i + 1 of one word.
        A round merges the lowest pair of each word and looks up only the pairs that this made anew.
        """
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(length)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        rank = np.full(len(sym), self.none, dtype=np.int32)
        if len(sym) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            keep = each != self.none
            if not keep.all():
                done.append((word[~keep], sym[~keep]))
                sym, word, rank, each = sym[keep], word[keep], rank[keep], each[keep]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == each)
            # of places that overlap, every second from the left; of a pair that must go alone, the first
            if len(place) > 1:
                run = np.r_[True, place[1:] != place[:-1] + 1]
                nth = np.arange(len(place))
                take = (nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0
                if self.any_alone:
                    first = np.r_[True, word[place[1:]] != word[place[:-1]]]
                    take = np.where(self.alone[rank[place]], first, take)
                place = place[take]
            sym[place] = self.made[rank[place]]
            keep = np.ones(len(sym), dtype=bool)
            keep[place + 1] = False
            at = place - np.arange(len(place))
            rank[place] = self.none
            sym, word, rank = sym[keep], word[keep], rank[keep]
            fresh = np.zeros(len(sym) + 1, dtype=bool)
            fresh[at] = fresh[at - 1] = True
            anew = np.flatnonzero(fresh[: len(sym) - 1])
            same = word[anew] == word[anew + 1]
            rank[anew[~same]] = self.none
            anew = anew[same]
            rank[anew] = self.pair_ranks(sym[anew], sym[anew + 1])
        all_words, all_ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(all_words, kind="stable")
        ids = all_ids[order].astype("<u4")
        cuts = np.searchsorted(all_words[order], np.arange(len(words) + 1)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, new: Iterable[str]) -> None:
        """Put words into the cache, some flat array at a time."""
        part: list[str] = []
        size = 0
        for w in [*new, None]:
            if part and (w is None or size > FLAT_SYMBOLS):
                raw = [x.encode("utf-8", "surrogatepass") for x in part]
                self.cache.update(zip(part, self.merge_rounds(raw), strict=True))
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is as empty."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS or not self.cache:
            self.cache = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        self.learn(set().union(*split) - self.cache.keys())
        return [b"".join(map(self.cache.__getitem__, x)) for x in split]

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary names no decoder, so tokens stand as written, one blank between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


Kernel = Callable[[WordBpe, list[str | None]], list[pa.Array]]


def _with(docs: DataFrame, path: str, kernel: Kernel, added: T.StructType, text: str) -> DataFrame:
    """docs with the columns that kernel makes of the texts; a column of docs with such a name gives way."""
    bounded_batches(docs.sparkSession)
    names = [f.name.lower() for f in added]
    kept = docs.select(*[c for c in docs.columns if c.lower() not in names])
    schema = T.StructType([*kept.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *kernel(bpe, texts)], names=schema.names)

    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens (long) and ids (array of int), the tokens of each whole text.

    Null or empty text: no tokens, an empty array. Rows are taken one by one, so ties, repeated rows,
    nulls and further columns stay as they are; columns n_tokens and ids of docs are replaced.
    """

    def kernel(bpe: WordBpe, texts: list[str | None]) -> list[pa.Array]:
        found = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_batch(texts)]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        flat = pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int32)]))
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
        return [pa.array(sizes), ids]

    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _with(docs, path, kernel, added, text)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with decoded (string), made of the column ids; null ids give null."""
    bounded_batches(tokens.sparkSession)
    kept = tokens.select(*[c for c in tokens.columns if c.lower() != "decoded"])
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [bpe.decode(np.array(x, dtype=np.int64)) if x is not None else None for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and then decoded where
    it is read, so that neither ids nor decoded texts leave the task. Null text is as empty."""

    def kernel(bpe: WordBpe, texts: list[str | None]) -> list[pa.Array]:
        raw = bpe.encode_batch(texts)
        ids = [np.frombuffer(x, dtype="<u4") for x in raw]
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
        ]

    added = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    made = _with(docs.select(F.col("doc_id").cast("long"), "text"), path, kernel, added, "text")
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
