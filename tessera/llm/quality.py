"""Quality rules: base statistics, then a hashed n-gram likelihood ratio of a trusted target against the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, words

#: Bytes of one n-gram, and buckets that the n-grams are hashed to. The model is one number a bucket.
NGRAM, BUCKETS = 4, 1 << 16
#: Added to each bucket's count in the target, and in proportion to their sizes in the corpus, so that an
#: n-gram that is too rare to be expected in the target says little.
SMOOTHING = 3.0
#: Mean log ratio of an n-gram, in nats, below which a document goes.
THRESHOLD = -0.2
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20


def repeated_words(ws: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window which the text has twice or more, first places included."""
    windows = list(zip(*(ws[i:] for i in range(k)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, end, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + k - max(end, i)
            end = i + k
    return covered


def base_statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    rep = repeated_words(ws)
    return len(ws), chars, symbols, dup, rep, len(ws) < MIN_WORDS or 100 * rep > REPEAT_PERCENT * len(ws)


def hashed_ngrams(text: str | None) -> np.ndarray:
    """Bucket of each n-gram of bytes, in text order; a text under NGRAM bytes has none."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < NGRAM:
        return np.zeros(0, dtype=np.uint32)
    packed = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    return (packed * np.uint32(2654435761)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = np.bincount(hashed_ngrams(text), minlength=BUCKETS)
            raw += n
            if trusted:
                target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"]
    )


def fit_log_ratio(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray | None:
    """log p_target - log p_raw of each bucket, from every n-gram of every document.

    trusted: rows (doc_id) of the target. Each task sums its own n-grams first, so at most BUCKETS
    rows leave it and BUCKETS rows reach the driver, whatever the corpus. None without a target n-gram.
    """
    bounded_batches(docs.sparkSession)
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    # Dealt by id at every size: the ids grow with the labels, so none is sent to all executors.
    marked = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left").select("text", "trusted")
    rows = (
        marked.mapInArrow(_count, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return None
    ratio = target.sum() / raw.sum()
    # both multinomials' totals, with what is added to them, cancel
    return np.log((target + smoothing) / (ratio * raw + smoothing))


def score(text: str | None, log_ratio: np.ndarray | None) -> float:
    """Mean log ratio of a text's n-grams, rounded so that it doesn't hang on addition order; 0 without any."""
    grams = hashed_ngrams(text)
    return round(float(log_ratio[grams].sum(dtype=np.float64)) / len(grams), 9) if log_ratio is not None and len(grams) else 0.0


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, llr double"
)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with base statistics, llr (the length-normalised log-likelihood ratio of its
    hashed n-grams between the trusted target and the whole corpus) and kept.

    docs: doc_id, text; other columns are ignored. trusted: doc_id of the target documents.
    kept: not base_failed and llr >= threshold. Null or empty text: no words, so base_failed. A null
    doc_id keeps its row and is never trusted; repeated rows each get a row. No target: llr is 0 and
    only the base rules decide. An empty table gives an empty result. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    ratio = fit_log_ratio(docs, trusted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s, base = score(text, ratio), base_statistics(text)
                rows.append((*base, not base[-1] and s >= threshold, s))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, SCHEMA)


def keep_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules() keeps, all their columns, filtered where they are read."""
    bounded_batches(docs.sparkSession)
    ratio = fit_log_ratio(docs, trusted)
    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(
                pa.array([not base_statistics(x)[-1] and score(x, ratio) >= threshold for x in texts], pa.bool_())
            )

    return docs.mapInArrow(good, docs.schema)
