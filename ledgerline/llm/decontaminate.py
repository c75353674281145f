"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton, item after item. Tasks stream each document's words
through it and track, word by word, the longest suffix that occurs in an item. Where that length
reaches the window, the last `window` words are an item's window; items shorter than the window
count when they occur whole. The automaton is the only broadcast and its size is checked: items
beyond `block_bytes` of text are split by hash into blocks of that size, and the same scan runs
once per block; what all but the last found is written with the rows, so that a worker holds one
automaton at a time. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_LOWER, plain_names, text_slices, written

WINDOW = 10
#: All ASCII but digits and letters separates words; A-Z is lower-cased.
NORMAL = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(ASCII_LOWER)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class ItemAutomaton:
    """Generalised suffix automaton over the word codes of (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [name for name, _ in items]
        paths = []
        for _, text in items:
            word = [self.codes.setdefault(w, len(self.codes)) for w in normal_words(text)]
            last, path = 0, []
            for c in word:
                last = self._extend(last, c)
            paths.append(word)
        # which items have a window that ends in a state: (its length, item)
        self.marks: dict[int, set[tuple[int, int]]] = {}
        self.least = window
        for item, word in enumerate(paths):
            if not word:
                continue
            k = min(window, len(word))
            self.least = min(self.least, k)
            state, size = 0, 0
            for c in word:
                state, size = self.step(state, size, c)
                if size >= k:
                    at = self.holding(state, k)
                    self.marks.setdefault(at, set()).add((k, item))
        # the nearest state with marks on the way to the root, itself included
        self.marked = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.marks else self.marked[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest suffix of (match so far + c) that occurs in an item."""
        nxt, link, length = self.next, self.link, self.length
        while state and c not in nxt[state]:
            state = link[state]
            size = length[state]
        if c in nxt[state]:
            return nxt[state][c], size + 1
        return 0, 0

    def holding(self, state: int, k: int) -> int:
        """The state of the suffix of k words."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit spans [from, to) of word positions, in order and apart, and the items that occur."""
        code = np.fromiter((self.codes.get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (code >= 0).astype(np.int8), [0]))))
        spans: list[list[int]] = []
        found: set[int] = set()
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if stop - start < self.least:
                continue
            state = size = 0
            for at, c in enumerate(code[start:stop].tolist(), start):
                state, size = self.step(state, size, c)
                if size < self.least:
                    continue
                s, reach = self.marked[state], 0
                while s > 0:
                    for k, item in self.marks[s]:
                        if k <= size:
                            found.add(item)
                            reach = max(reach, k)
                    s = self.marked[self.link[s]]
                if reach:
                    begin = at + 1 - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append([begin, at + 1])
        return spans, found


def merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, a block of bounded size at a time. Rows without an id or a text hold no test item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(1.5 * size / block_bytes) if size > block_bytes else 1)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield sorted((r.item_id, r.text.encode()) for r in part.toLocalIterator())


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, names: tuple[str, str, str], finish: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch] | None = None, schema: StructType | None = None) -> DataFrame:
    """docs with three more columns: hit spans (flat), number of words, ids of the items that occur; or what
    `finish` makes of a batch of them and its texts, in the same pass. A block of items is a pass over the
    rows: those before the last are written, and their automata leave the executors."""
    spans_at, words_at, items_at = names
    out = docs.withColumns({spans_at: F.expr("cast(array() as array<long>)"), words_at: F.lit(0).cast("long"), items_at: F.expr("cast(array() as array<string>)")})
    blocks = item_blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window))
        then = finish if following is None else None

        def work(batches: Iterator[pa.RecordBatch], shared=shared, then=then) -> Iterator[pa.RecordBatch]:
            machine = shared.value
            for batch in batches:
                for part, texts in text_slices(batch):
                    spans, counts, items = [], [], []
                    for row, was, had in zip(texts, part.column(spans_at).to_pylist(), part.column(items_at).to_pylist(), strict=True):
                        words = normal_words(row)
                        hit, found = machine.scan(words)
                        spans.append([x for s in merged(hit, [was[i : i + 2] for i in range(0, len(was), 2)]) for x in s])
                        counts.append(len(words))
                        items.append(sorted({*had, *(machine.items[i] for i in found)}))
                    for name, values, kind in ((spans_at, spans, pa.list_(pa.int64())), (words_at, counts, pa.int64()), (items_at, items, pa.list_(pa.string()))):
                        part = part.set_column(part.schema.get_field_index(name), name, pa.array(values, kind))
                    yield then(part, texts) if then else part

        out = out.mapInArrow(work, schema if then else out.schema)
        if following is not None:
            out = written(out, "scanned")
            shared.destroy()
        block = following
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: words, hit words, items that occur and their digest.

    Null and empty texts have no words. Items without words occur nowhere; a repeated item_id counts
    once; rows of the benchmark with a null id or text are no items. Repeated documents are reported
    each; other columns are not read; an empty benchmark leaves every document clean.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = scanned(rows, benchmark, window, block_bytes, ("spans", "n_words", "items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: x - total)  # ends less starts: signs alternate, pairs are even
    return seen.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the spans of words, each with what separates it from the next word."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    keep, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep.append(text[done : starts[a]])
        done = starts[b]
    return b"".join([*keep, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """documents without benchmark passages, the same columns: hit spans are cut out of the text and
    n_chars follows; a document with more than `max_coverage` of its words hit goes.

    Documents without a hit, null texts included, stay as they are; repeated rows are cut alike; other columns go
    along whatever their names; an empty table stays empty, and an empty benchmark cuts nothing.
    """
    plain = plain_names(docs)
    tag = "ledgerline_scan_"
    names = (f"{tag}spans", f"{tag}words", f"{tag}items")
    counted = "n_chars" in docs.columns

    def finish(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        spans = part.column(names[0]).to_pylist()
        total = part.column(names[1]).to_pylist()
        hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        keep = pa.array([h <= max_coverage * n for h, n in zip(hit, total, strict=True)], pa.bool_())
        part = part.drop_columns(list(names))
        if any(spans):
            old = part.column("text").to_pylist()
            new = [cut(t, s).decode() if s else o for t, s, o in zip(texts, spans, old, strict=True)]
            at = part.schema.get_field_index("text")
            part = part.set_column(at, part.schema.field("text"), pa.array(new, part.schema.field("text").type))
            if counted:
                at, field = part.schema.get_field_index("n_chars"), part.schema.field("n_chars")
                sizes = [len(t) if s else was for t, s, was in zip(new, spans, part.column("n_chars").to_pylist(), strict=True)]
                part = part.set_column(at, field, pa.array(sizes, field.type))
        return part.filter(keep)

    return scanned(plain, benchmark, window, block_bytes, names, finish, plain.schema).toDF(*docs.columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
