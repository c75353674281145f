"""Quality rules from repetition inside a text, by suffix array.

The suffixes of each text's words are sorted by prefix doubling; common-prefix lengths of
neighbours give, for each position, the longest substring starting there that occurs again in the
text. Those maximal repeats become spans, their union the covered share. Whole Arrow batches are
worked on at once with numpy; only suffixes whose first three words recur in their text are
refined, since the others can't begin a repeat of three words. Rows are independent: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, plain_names, sums_by_row, text_slices, word_codes

SYMBOLS = b"#*$%&|<>"
SEED = 3

REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_long_repeat_words long, longest_repeat long"
)


def repeat_lengths(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that begins there and occurs again in the
    same text, if that is SEED words or more, else 0."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < SEED:
        return longest
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    word = np.concatenate((codes + 1, np.zeros(SEED, np.int64)))  # 0 stands behind the last word
    at = np.arange(n)
    base = int(codes.max()) + 2
    second = np.where(at + 1 < ends, word[1 : n + 1], 0)
    third = np.where(at + 2 < ends, word[2 : n + 2], 0)
    key = word[:n] * base + second
    if base > 1 << 20:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * base + third
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)  # where the suffix's group begins in sorted order
    rank[order] = np.repeat(first, size)
    active = order[np.repeat(size > 1, size)]
    if not len(active):
        return longest
    suffixes, levels, length = active, [(SEED, rank.copy())], SEED
    while len(active):
        nxt = active + length
        inside = nxt < ends[active]
        nxt_rank = np.where(inside, rank[np.minimum(nxt, n - 1)], -1)
        pair = rank[active] * (n + 1) + nxt_rank + 1
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        group = rank[active]
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(active)))
        outer = np.concatenate(([True], group[1:] != group[:-1]))
        begin = np.maximum.accumulate(np.where(outer, np.arange(len(active)), 0))
        rank[active] = group + np.repeat(first, size) - begin
        active = active[np.repeat(size > 1, size)]
        length *= 2
        if len(active):
            levels.append((length, rank.copy()))
    sa = suffixes[np.argsort(rank[suffixes], kind="stable")]
    a, b = sa[:-1], sa[1:]
    common = np.zeros(len(a), np.int64)
    live = levels[0][1][a] == levels[0][1][b]
    for step, ranks in reversed(levels):
        x, y = a + common, b + common
        inside = live & (x < ends[a]) & (y < ends[b])
        same = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
        common += np.where(same, step, 0)
    for _ in range(SEED - 1):
        x, y = a + common, b + common
        same = live & (x < ends[a]) & (y < ends[b]) & (word[np.minimum(x, n)] == word[np.minimum(y, n)])
        # a word that differs ends the match: later rounds compare the same two words again
        common += same
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """1 for each word inside a repeat of `least` words or more."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.int64)


def judge(texts: list[bytes], min_span: int, max_share: float, max_repeat: int, max_repeat_share: float) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    codes, counts, _ = word_codes(words)
    longest = repeat_lengths(codes, counts)
    repeat = sums_by_row(covered(longest, SEED), counts)
    spans = sums_by_row(covered(longest, min_span), counts)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(counts)), counts), longest)
    chars, symbols, dup = [], [], []
    for t in texts:
        solid = t.translate(None, BLANKS)
        chars.append(len(solid.decode("utf-8", "replace")))
        symbols.append(len(solid) - len(solid.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    failed = (counts < 50) | (100 * repeat > 50 * counts)
    bad = (spans > max_share * counts) | ((most > max_repeat) & (most > max_repeat_share * counts))
    return {
        "n_words": counts, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & ~bad,
        "n_long_repeat_words": spans, "longest_repeat": most,
    }


#: Words in a span that counts towards the covered share; the share; a longest repeat that is too
#: long when it is also more than that share of the text.
DEFAULTS = {"min_span": 8, "max_share": 0.3, "max_repeat": 50, "max_repeat_share": 0.15}


def repetition_report(docs: DataFrame, **limits: float) -> DataFrame:
    """One row per document with its counts and verdict.

    Null and empty texts have no words, so they fail the base rule; a null doc_id stays null;
    repeated rows are judged one by one; other columns are not read; an empty table gives no rows.
    """
    limits = DEFAULTS | limits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                found = judge(texts, **limits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(work, REPORT)


def quality_filter(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, all their columns unchanged, whatever their names; null and empty texts go, repeated
    rows stay or go together, an empty table stays empty."""
    limits, plain = DEFAULTS | limits, plain_names(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(judge(texts, **limits)["kept"]))

    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
