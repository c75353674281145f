"""Token counts of a unigram vocabulary, by dynamic programming shared along a trie.

Each task collects the distinct pre-tokens of a stretch of texts and walks their trie depth first
(sorted order): the forward scores of a prefix are computed once and serve every pre-token below
it. A node keeps the best score of a segmentation that ends there and its number of tokens; at a
terminal that number is the pre-token's count. Documents then add up the counts of their
pre-tokens. Rows are independent: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sums_by_row, text_slices, word_codes

SPACE = "▁"
#: The score of each byte of a character that no piece covers.
BYTE_SCORE = -25.0


def vocabulary(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece file with unigram scores. A file without unigram scores (a merge list
    ranks its pieces) gets -ln(2 + rank) by the order of its pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in pieces]
    ranks = all(float(s).is_integer() for s in scores)
    return {model.id_to_piece(i): -log(2 + n) if ranks else float(s) for n, (i, s) in enumerate(zip(pieces, scores, strict=True))}


class TrieCounter:
    """Counts of pre-tokens; those seen before are kept, up to `room`."""

    def __init__(self, pieces: dict[str, float], room: int = 500_000) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.known: dict[bytes, int] = {}
        self.room = room

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.room:
            self.known.clear()
        self.walk(sorted((SPACE + w.decode("utf-8", "replace"), w) for w in words if w not in self.known))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def walk(self, words: list[tuple[str, bytes]]) -> None:
        """Sorted words: what a word shares with the one before it is the path from the root that both pass."""
        pieces, longest = self.pieces, self.longest
        score, tokens = [0.0], [0]  # forward values of the nodes on the path, by depth
        before = ""
        for word, raw in words:
            shared = len(commonprefix((before, word)))
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "replace"))
                best, count = score[end - 1] + BYTE_SCORE * size, tokens[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    piece = pieces.get(word[begin:end])
                    if piece is not None:
                        total = score[begin] + piece
                        if total > best or (total == best and tokens[begin] + 1 < count):
                            best, count = total, tokens[begin] + 1
                score.append(best)
                tokens.append(count)
            self.known[raw] = tokens[-1]
            before = word


_counters: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    """One per Python worker."""
    if path not in _counters:
        _counters[path] = TrieCounter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens.

    Null and empty texts have none; a null doc_id stays null; repeated rows are counted each; a pre-token
    of any length is worked on whole; other columns are not read; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = counter(vocabulary_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                codes, sizes, words = word_codes([t.split() for t in texts])
                tokens = sums_by_row(trie.counts(words)[codes], sizes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_pretokens long, n_tokens long")
