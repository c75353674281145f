"""Language-model scores by context-tree weighting over bytes, with a word unigram beside it.

The model predicts each byte of the lower-cased text (and an end mark) from the DEPTH bytes before
it, a bit at a time. Every context of every depth has, for each bit node, a Krichevsky-Trofimov
estimate; the tree mixes them: Pw = 1/2 Pe + 1/2 * product of Pw over longer contexts. Counts come
from the training documents; scoring walks the mixture with the weights 1/2 Pe / Pw frozen.

Counting: tasks reduce their texts to distinct words and byte strings of DEPTH + 1 with counts, and
these are summed by key. Tree: byte strings are dealt by their nearest two context bytes, under
which the tree splits into parts that meet only at depths 0 and 1; the parts send up the weighted
probabilities of their depth-2 nodes (at most 2**16 contexts of 255 nodes, whatever the corpus), and
the top of the tree goes back to them as a table of fixed size. Scoring: the values travel to where
the texts are. Texts are dealt to chunks by hash; each chunk asks for the words and byte strings it
holds, so a frequent key is asked for once per chunk and no table is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, sums_by_row, text_slices, word_codes, written

DEPTH = 5
END = 0xFF  # no byte of UTF-8
TOP = 2  # depths below this one make the top of the tree
CHUNK_BYTES = 24 << 20
SLICE_BYTES = 3 << 19
WORDS, STRINGS, TEXTS = 0, 1, 2
END_WORD = 0  # the key of the end token; a word's key has its lowest bit set
LN2 = float(np.log(2.0))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2: the recurrence up to 8 and more, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift -= np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def log_mix(pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(pe, below) - LN2


#: For each byte and bit position: its node in the byte's binary tree, and the bit.
NODES = np.array([[(1 << j) | (s >> (8 - j)) for j in range(8)] for s in range(256)], np.int64)
BITS = np.array([[(s >> (7 - j)) & 1 for j in range(8)] for s in range(256)], np.int64)


class Level:
    """All nodes of one depth in a part of the tree: key = context << 8 | node, ascending."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int) -> None:
        seen = counts > 0
        strings, counts = strings[seen], counts[seen]
        symbol = strings & 0xFF
        context = (strings >> 8) & ((1 << 8 * depth) - 1)
        key = ((context[:, None] << 8) | NODES[symbol]).ravel()
        self.key, at = np.unique(key, return_inverse=True)
        n = np.repeat(counts, 8).astype(np.float64)
        bit = BITS[symbol].ravel()
        self.zeros = np.bincount(at, n * (1 - bit), len(self.key))
        self.ones = np.bincount(at, n * bit, len(self.key))
        self.pe = log_kt(self.zeros, self.ones)
        self.pw = self.pe

    def under(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums of this level's ln Pw by the nodes one depth up, as (key, sum)."""
        up = self.key & ((1 << 8 * depth) - 1)
        keys, at = np.unique(up, return_inverse=True)
        return keys, np.bincount(at, self.pw, len(keys))

    def weigh(self, keys: np.ndarray, below: np.ndarray) -> None:
        self.pw = log_mix(self.pe, below[np.searchsorted(keys, self.key)])

    def at(self, key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight of stopping here, probability of the bit); unseen nodes have 1/2 and 1/2."""
        if not len(self.key):
            return np.full(key.shape, 0.5), np.full(key.shape, 0.5)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[i] == key
        n = np.where(bit == 1, self.ones[i], self.zeros[i])
        weight = np.exp(np.minimum(0.0, self.pe[i] - self.pw[i] - LN2))
        return np.where(there, weight, 0.5), np.where(there, (n + 0.5) / (self.zeros[i] + self.ones[i] + 1.0), 0.5)


def levels(strings: np.ndarray, counts: np.ndarray, top: int) -> list[Level]:
    """The weighted levels top..DEPTH of the part of the tree that the strings make."""
    out = [Level(strings, counts, d) for d in range(top, DEPTH + 1)]
    for d in range(DEPTH - 1, top - 1, -1):
        out[d - top].weigh(*out[d - top + 1].under(d + 1))
    return out


def top_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, pw: np.ndarray) -> list[Level]:
    """Depths 0..TOP-1 from the depth-TOP nodes of all parts."""
    out: list[Level] = []
    for d in range(TOP - 1, -1, -1):
        up = keys & ((1 << 8 * (d + 1)) - 1)
        level = Level.__new__(Level)
        level.key, at = np.unique(up, return_inverse=True)
        level.zeros, level.ones = np.bincount(at, zeros, len(level.key)), np.bincount(at, ones, len(level.key))
        level.pe = log_kt(level.zeros, level.ones)
        level.pw = log_mix(level.pe, np.bincount(at, pw, len(level.key)))
        out.insert(0, level)
        keys, zeros, ones, pw = level.key, level.zeros, level.ones, level.pw
    return out


def log10_of(strings: np.ndarray, tree: list[Level]) -> np.ndarray:
    """log10 of the probability of each string's last byte behind the others."""
    symbol = strings & 0xFF
    node, bit = NODES[symbol], BITS[symbol]
    mass, p = np.ones(node.shape), np.zeros(node.shape)
    for d, level in enumerate(tree):
        context = (strings >> 8) & ((1 << 8 * d) - 1)
        weight, here = level.at((context[:, None] << 8) | node, bit)
        if d == DEPTH:
            weight = np.ones_like(weight)
        p += mass * weight * here
        mass *= 1.0 - weight
    return np.log10(p).sum(axis=1)


def byte_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings of DEPTH + 1 bytes ending at each byte and at the end mark, number per text). Zeros stand
    before a text."""
    joined = np.frombuffer(b"".join(b"\0" * DEPTH + t + bytes([END]) for t in texts), np.uint8).astype(np.int64)
    n = len(joined) - DEPTH
    rolled = np.zeros(max(n, 0), np.int64)
    for i in range(DEPTH + 1):
        rolled = (rolled << 8) | joined[i : i + n]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    at = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return rolled[at], sizes


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64) | 1


def held_out(doc_id: object, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


class Tally:
    """Distinct keys with counts, kept merged."""

    def __init__(self) -> None:
        self.keys, self.counts = [], []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 3 << 19:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.counts = [keys], [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        self.held = len(self.keys[0]) if self.keys else 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, text): chunks of about CHUNK_BYTES by hash of the whole row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // CHUNK_BYTES)).alias("chunk"), "doc_id", "text")


def counted(rows: DataFrame, folds: int, fold: int) -> DataFrame:
    """(chunk, kind, key, n): each chunk's distinct words and byte strings with their training counts."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        tallies = (Tally(), Tally())

        def given() -> Iterator[pa.RecordBatch]:
            for kind, tally in enumerate(tallies):
                keys, counts = tally.merge()
                for i in range(0, len(keys), 1 << 18):
                    k = keys[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), now)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[i : i + len(k)])], schema=schema)

        for batch in batches:
            for part, texts in text_slices(batch, limit=SLICE_BYTES):
                chunk = part.column("chunk").to_numpy()
                learn = np.array([not held_out(d, folds, fold) for d in part.column("doc_id").to_pylist()])
                lower = [t.translate(ASCII_LOWER) for t in texts]
                for c in dict.fromkeys(chunk.tolist()):
                    if c != now:
                        if now is not None:
                            yield from given()
                        now, tallies = c, (Tally(), Tally())
                    for mode in (True, False):
                        some = [t for t, x, l in zip(lower, chunk, learn, strict=True) if x == c and l == mode]
                        if not some:
                            continue
                        codes, _, words = word_codes([t.split() for t in some])
                        n = np.bincount(codes, minlength=len(words)) if mode else np.zeros(len(words), np.int64)
                        tallies[WORDS].add(np.append(word_keys(words), END_WORD), np.append(n, len(some) if mode else 0))
                        strings, times = np.unique(byte_strings(some)[0], return_counts=True)
                        tallies[STRINGS].add(strings, times if mode else np.zeros(len(times), np.int64))
        if now is not None:
            yield from given()

    sorted_rows = rows.repartition("chunk").sortWithinPartitions("chunk")
    return sorted_rows.mapInArrow(work, "chunk long, kind byte, key long, n long")


def region() -> Column:
    """The nearest TOP context bytes of a byte string."""
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))


def parts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of whole regions at a time, about `limit` rows; the rows come sorted by region."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy()))
        counts = np.concatenate((counts, batch.column("n").to_numpy()))
        if len(keys) >= limit:
            of = (keys >> 8) & ((1 << 8 * TOP) - 1)
            cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if of[0] != of[-1] else 0
            if cut:
                yield keys[:cut], counts[:cut]
                keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield keys, counts


def string_values(strings: DataFrame) -> DataFrame:
    """(key, n) of all byte strings -> (key, value): log10 of the last byte's probability."""
    dealt = written(strings, "context-strings").repartition(region()).sortWithinPartitions(region())

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in parts(batches):
            level = levels(keys, counts, TOP)[0]
            yield pa.RecordBatch.from_arrays([pa.array(level.key), pa.array(level.zeros), pa.array(level.ones), pa.array(level.pw)], names=["key", "zeros", "ones", "pw"])

    # at most 2**16 contexts of 255 nodes
    found = dealt.mapInArrow(up, "key long, zeros double, ones double, pw double").toArrow()
    order = np.argsort(found.column("key").to_numpy())
    columns = [found.column(c).to_numpy()[order] for c in ("key", "zeros", "ones", "pw")]
    shared = strings.sparkSession.sparkContext.broadcast(top_levels(*columns))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in parts(batches):
            tree = [*shared.value, *levels(keys, counts, TOP)]
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(log10_of(k, tree))], names=["key", "value"])

    return dealt.mapInArrow(down, "key long, value double")


def scored(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null and empty texts are an end token and an end mark. A null doc_id counts as training. Repeated
    rows are learned from and scored each; other columns are not read; an empty table gives no rows.
    With nothing to learn from all estimates are the priors.
    """
    rows = chunked(docs)
    asked = written(counted(rows, folds, fold), "context-counts")
    words = asked.where(F.col("kind") == WORDS).groupBy("key").agg(F.sum("n").alias("n"))
    words = written(words, "context-words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train, distinct = int(total.n or 0), int(total.v or 0)
    base = F.log10((F.col("n") + 0.5) / F.lit(n_train + 0.5 * (distinct + 1)))
    strings = asked.where(F.col("kind") == STRINGS).groupBy("key").agg(F.sum("n").alias("n"))
    values = words.select(F.lit(WORDS).cast("byte").alias("kind"), "key", F.when(F.col("n") > 0, base).alias("value"))
    values = values.unionByName(string_values(strings).select(F.lit(STRINGS).cast("byte").alias("kind"), "key", "value"))
    unseen = float(np.log10(0.5 / (n_train + 0.5 * (distinct + 1))))
    answers = asked.select("chunk", "kind", "key").join(values, ["kind", "key"])
    # texts use the key column for their doc_id: narrow rows, since all of a chunk's are sorted together
    both = answers.select("chunk", "kind", "key", "value", F.lit(None).cast("string").alias("text")).unionByName(
        rows.select("chunk", F.lit(TEXTS).cast("byte").alias("kind"), F.col("doc_id").alias("key"), F.lit(None).cast("double").alias("value"), "text")
    )
    ready = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        fresh: list[list] = [[], []]
        tables: list[tuple] = []

        def table(kind: int) -> tuple:
            """Sorted keys and their values; a word without a value was never learned."""
            keys = np.concatenate([np.empty(0, np.int64), *(k for k, _ in fresh[kind])])
            order = np.argsort(keys)
            return keys[order], np.concatenate([np.empty(0), *(v for _, v in fresh[kind])])[order]

        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            for c in dict.fromkeys(chunks.tolist()):
                here = chunks == c
                if c != now:
                    now, fresh, tables = c, [[], []], []
                for kind in (WORDS, STRINGS):
                    if (pick := here & (kinds == kind)).any():
                        part = batch.filter(pa.array(pick))
                        fresh[kind].append((part.column("key").to_numpy(), part.column("value").to_numpy(zero_copy_only=False)))
                if not (pick := here & (kinds == TEXTS)).any():
                    continue
                if not tables:
                    tables, fresh = [table(WORDS), table(STRINGS)], [[], []]
                for part, texts in text_slices(batch.filter(pa.array(pick)), limit=SLICE_BYTES):
                    ids = part.column("key").to_pylist()
                    lower = [t.translate(ASCII_LOWER) for t in texts]
                    codes, counts, words = word_codes([t.split() for t in lower])
                    keys, value = tables[WORDS]
                    worth = value[np.searchsorted(keys, np.append(word_keys(words), END_WORD))]
                    known, worth = ~np.isnan(worth), np.where(np.isnan(worth), unseen, worth)
                    score, seen = sums_by_row(worth[codes], counts) + worth[-1], sums_by_row(known[codes].astype(np.int64), counts) + int(known[-1])
                    strings, sizes = byte_strings(lower)
                    some, place = np.unique(strings, return_inverse=True)
                    keys, value = tables[STRINGS]
                    model = np.add.reduceat(value[np.searchsorted(keys, some)][place], np.cumsum(sizes) - sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array([held_out(d, folds, fold) for d in ids], pa.bool_()), pa.array(counts + 1), pa.array(seen), pa.array(np.full(len(ids), n_train)), pa.array(score), pa.array(model), pa.array(sizes - 1), pa.array(-model / np.log10(2.0) / np.maximum(1, sizes - 1))],
                        schema=schema,
                    )

    return ready.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
