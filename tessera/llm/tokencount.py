"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pre-tokens of one task that stay known; beyond that it starts anew.
CACHE_WORDS = 500_000
#: The mark that the vocabulary's pieces have for a blank before a word.
BLANK = "▁"
#: A character without a piece counts as its UTF-8 bytes, each at this log probability.
BYTE_SCORE = -20.0
#: A pre-token: a run of letters, of digits or of other visible characters, with one blank before it if
#: there is one; other white space stands alone, character by character.
PRETOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class UnigramCounter:
    """Counts the tokens of the most probable segmentation.

    The piece of rank r (in the vocabulary's order) gets log probability -log(r + 2): the vocabulary
    gives no probabilities, and a rank law needs no training. Of segmentations that tie, the one whose
    last piece is longer wins, then that of the prefix before it likewise.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = {p: -log(r + 2) for r, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.split = regex.compile(PRETOKEN).findall
        self.known: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Store the token count at the terminal of each word.

        In sorted order the words are the walk of a trie: what a word shares with the one before it is
        the path to their common node, whose forward scores stand in `best` and `count` already, so
        each node of the trie is scored once.
        """
        best, count, path = [0.0], [0], ""
        scores, longest = self.scores, self.longest
        for word in sorted(words):
            text = word.replace(" ", BLANK)
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                n_bytes = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, tokens = best[end - 1] + n_bytes * BYTE_SCORE, count[end - 1] + n_bytes
                for start in range(end - 1, max(end - longest, 0) - 1, -1):
                    s = scores.get(text[start:end])
                    if s is not None and best[start] + s >= top:
                        top, tokens = best[start] + s, count[start] + 1
                best.append(top)
                count.append(tokens)
            path = text
            self.known[word] = count[-1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        self.learn(set().union(*split) - self.known.keys())
        known = self.known.__getitem__
        return [len(x) for x in split], [sum(map(known, x)) for x in split]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(path)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens (long) of each whole text of docs.

    Null or empty text: 0 and 0. Rows are taken one by one: repeated rows, ties and null ids keep a row
    each; other columns are ignored. An empty table gives an empty result. The trie lives in a task and
    starts anew beyond CACHE_WORDS words, which changes no count.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            pre, tok = c.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pre, pa.int64()), pa.array(tok, pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long"
    )
