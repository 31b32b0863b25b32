"""Substring dedup by seed and extend: anchors are the seeds, matches grow both ways word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .anchors import Units, contexts, merged, pairs, prepared, repeats, with_spans
from .common import words

#: Words of a repeat at least, and words of a seed.
WINDOW, SEED = 20, 6


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


_NUMBERS = WordNumbers()


def word_numbers(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_NUMBERS.__getitem__, ws), dtype=np.uint64, count=len(ws))


def word_units(window: int = WINDOW, seed: int = SEED) -> Units:
    return Units(seed, window, words, word_numbers, b" ".join)


def joint_classes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(a * (np.int64(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def extend(window: int):
    """Resolver of anchors.repeats(): which windows an earlier context of the same seed has as well.

    All contexts of a seed are extended at once. right[r] tells contexts apart by seed and the r words
    from the seed's start on, left[l] by the l words before it; each step splits the classes of the step
    before by one more word, so contexts stay together exactly as far as they match. A window that
    begins l words before the seed is an earlier one's too if both classes, of l and of window - l
    words, have an earlier member with that window; neighbouring windows make up the maximal repeat.
    """

    def resolve(keys, before, after, texts) -> Iterator[tuple[int, int, int]]:
        n = len(keys)
        if n < 2:
            return
        ids: dict[bytes, int] = {}
        before, after = np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)
        split = [x.split(b" ") for x in texts]
        far = int(before.max())
        reach = window - int(after.min())
        cells = np.zeros((far + reach, n), dtype=np.int64)  # by place from the seed's start, then context
        for j, ws in enumerate(split):
            start = far - int(before[j])
            cells[start : start + len(ws), j] = [ids.setdefault(w, len(ids) + 1) for w in ws]
        group = np.unique(np.array(keys, dtype=np.int64), return_inverse=True)[1].astype(np.int64)
        left, right = [group], [group]
        for step in range(far):
            left.append(joint_classes(left[-1], cells[far - 1 - step]))
        for step in range(reach):
            right.append(joint_classes(right[-1], cells[far + step]))
        for l in range(int(after.min()), far + 1):
            has = np.flatnonzero((before >= l) & (after <= l))
            if len(has) < 2:
                continue
            both = joint_classes(left[l][has], right[window - l][has])
            _, first = np.unique(both, return_index=True)  # earlier contexts come first
            again = np.ones(len(has), dtype=bool)
            again[first] = False
            for i in has[again]:
                start = int(before[i]) - l
                yield int(i), start, start + window

    return resolve


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds kept (string).

    A word goes if a window of `window` words that covers it starts earlier too: in a smaller doc_id
    (null is smallest; of rows that share an id, by the hash of the text), or earlier in the document.
    Null or empty text: no words, the digest of the empty string. Texts under a window keep all. Rows
    that repeat id and text are one document and get equal rows. Other columns are ignored; an empty
    table gives an empty result. Texts of any length are taken whole.
    """
    units = word_units(window, seed)
    rows = prepared(docs)
    spans = repeats(contexts(rows, units, True), units, extend(window), later_only=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, digests, kept_texts = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = words(text)
                n, at, kept = len(ws), 0, []
                for start, end in merged(pairs(found)):
                    kept += ws[at:start]
                    at = end
                kept += ws[at:]
                joined = b" ".join(kept)
                sizes.append(n)
                gone.append(n - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode("utf-8", "replace") if with_text else None)
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return with_spans(rows, spans).mapInArrow(finish, SCHEMA + ", kept string" * with_text)


#: substring_dedup() over the table documents with ids that are neither null nor repeated.
DEDUP_SQL = f"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
keys AS (SELECT doc_id, i, w, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN array_to_string(ws[i : i + {WINDOW - 1}], ' ') END AS k FROM places),
ranked AS (SELECT doc_id, i, w, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM keys),
covered AS (SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM ranked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
