"""Small helpers shared by the corpus operators.

Word rules work on UTF-8 bytes: every separator and every letter that is lower-cased is ASCII, and
no byte of a multi-byte character is, so byte-wise work equals work on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..durable import run_dir, shared_dir, written

__all__ = ["ASCII_LOWER", "BLANKS", "LETTERS", "give_back", "plain_names", "run_dir", "shared_dir", "slices", "sums_by_row", "text_slices", "word_codes", "written"]

#: A-Z to a-z and nothing else.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The separators of words, [\x20\x09-\x0D]; also what bytes.split() splits at.
BLANKS = b" \t\n\x0b\x0c\r"
#: A-Z to a-z; what is no letter, [\x00-\x40\x5B-\x60\x7B-\x7F], to a blank.
LETTERS = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 0x80 else 32 for c in range(256))
#: glibc's malloc_trim, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def plain_names(docs: DataFrame) -> DataFrame:
    """The same rows with names that any pass can resolve: what is not doc_id, text or n_chars is named by its
    place, so dots, repeats and clashes don't matter; toDF(*docs.columns) gives the names back."""
    own = ("doc_id", "text", "n_chars")
    return docs.toDF(*[c if c in own else f"column_{i}" for i, c in enumerate(docs.columns)])


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """slices() with the texts as bytes; null is empty."""
    for part in slices(batch, column, limit):
        yield part, pc.fill_null(part.column(column).cast(pa.large_binary()), b"").to_pylist()


def word_codes(texts: list[list]) -> tuple[np.ndarray, np.ndarray, list]:
    """(codes of all words on end, words of each text, the distinct words by code)."""
    flat = [w for words in texts for w in words]
    known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    return codes, np.fromiter(map(len, texts), np.int64, len(texts)), list(known)


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`, `counts[i]` of them for row i."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
