"""Exact Jaccard join on word shingles: prefix lists, then T-occurrence search with DivideSkip.

1. One pass over the texts gives each document its number of shingles, a 128-bit signature of the
   set, and counts of shingles that recur inside a part of a task. Documents of equal sets become a
   class. Shingles with large counts, at most 2**20 of them by the threshold, are the hot ones.
2. A pair of 3/4 similarity shares a shingle among the rarest quarter (plus one) of each set, rare
   meaning not hot, then by count, then by hash. Those prefix shingles go to inverted lists, sorted
   by set size; a list is cut where sizes are too far apart to link.
3. Lists of up to PIECE documents are blocks; equal blocks (near copies share many lists) are kept
   once, and longer lists are cut into a chain of blocks that overlap by one document. Parity bitmaps
   of the sets bound the difference of two sets from below: in each block, the pairs that the bound
   allows make a forest of feasible edges. A long list whose documents the edges leave apart is
   gone through again, what is outside its largest part against all of it.
4. Components of the feasible edges are families: every link lies inside one. Families are a small
   part of the documents, and only their whole sets are moved, once.
5. In a family, each document is a query against the smaller ones: T-occurrence search with
   DivideSkip over inverted lists of the whole sets. A heap merges its short lists, skipping over
   documents that too few of them hold; its long ones are probed by binary search; what reaches the
   needed overlap is a link. A family returns a spanning forest of its links, never all pairs, and a
   query ends when no other component is left to link with. A family of more than FAMILY documents
   or FAMILY_HASHES shingles is searched in parts, heads of the parts meet in a chain of bridging
   blocks, and then what is outside its largest component meets all of it, part by part.
6. Components of the links are the result.

Broadcasts: the hot shingles (at most 2**20) and a bitmap of fixed size that spares shingling
documents without any shared list. Lists of very frequent shingles are salted.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, text_slices, word_codes, written
from .components import connected

WIDTH = 5
PIECE = 64
#: Bounds of what one task searches at once: documents, and shingles of their sets.
FAMILY = 2048
FAMILY_HASHES = 1 << 20
#: Heads of a part, and parts of a bridging block.
HEADS, CHAIN = 4, 32
#: Shingles among which a task looks for those that recur.
STRETCH = 1 << 21
HOT_TOKENS = 1 << 20
LEAST_HOT = 16
SALT_AT = 4096
#: Rows of one list that a task holds before it gives them out.
LONG_RUN = 1 << 16
BITMAP_BITS = 27
#: Skip factor of DivideSkip: long lists are T / (SKIP * log2(longest) + 1).
SKIP = 0.0085
#: Odd multipliers of the word positions in a shingle.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, counts, words = word_codes([t.translate(ASCII_LOWER).split() for t in texts])
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[codes]
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        if n > k:
            rolled[: n - k] += h[k:] * MULTIPLIERS[k]
    rolled = mixed(rolled)
    out, at = [], 0
    for size in counts.tolist():
        if size >= WIDTH:
            s = np.sort(rolled[at : at + size - WIDTH + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif size:
            few = (h[at : at + size] * MULTIPLIERS[:size]).sum(dtype=np.uint64) + np.uint64(size)
            out.append(mixed(np.array([few], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def signature(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bitmap of about as many bits as hashes, each the parity of the hashes that fall on it. Bits in
    which two sets differ are no more than the hashes in which they do."""
    bits = 1 << max(8, int(len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any partner: ceil(3 n / 4)."""
    return -(-3 * n // 4)


def document_statistics(rows: DataFrame) -> DataFrame:
    """kind 0: (doc_id, number of shingles, signature); kind 1: (shingle, count) seen twice or more in a stretch."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bits", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def recurring() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            edge = np.flatnonzero(every[1:] != every[:-1])  # the last of each run but one
            last = np.append(edge, len(every) - 1)
            counts = np.diff(last, prepend=-1)
            keys, counts = every[last[counts > 1]], counts[counts > 1]
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int8)), pa.array(keys.view(np.int64)), pa.array(counts), none, none, pa.nulls(len(keys), pa.binary())], schema=schema)

        for batch in batches:
            for part, texts in text_slices(batch):
                sets = shingle_sets(texts)
                signs = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int8)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in signs], pa.int64()), pa.array([b for _, b in signs], pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary())],
                    schema=schema,
                )
                for s, sign in zip(sets, signs, strict=True):
                    if sign not in seen:
                        seen.add(sign)
                        held.append(s)
                        size += len(s)
                if size > STRETCH:
                    yield recurring()
                    size = 0
                    seen.clear()
        if held:
            yield recurring()

    return rows.mapInArrow(work, "kind byte, key long, n long, s1 long, s2 long, bits binary")


def hot_shingles(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hot shingles and their counts; the threshold keeps them to HOT_TOKENS at most."""
    total = stats.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_HOT, -(-total // HOT_TOKENS))
    found = stats.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def prefixes(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, salt, n, doc_id): the prefix shingles of each document; equal sets of a task go once."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part, texts in text_slices(batch, limit=2 << 20):
                tokens, sizes, docs = [], [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(texts), strict=True):
                    if not len(s) or (sign := signature(s)) in seen:
                        continue
                    seen.add(sign)
                    want = len(s) - least_overlap(len(s)) + 1
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        weight = np.where(keys[at] == s, counts[at], 0)
                        cold = s[weight == 0]
                        if len(cold) < want:
                            warm = s[weight > 0][np.argsort(weight[weight > 0], kind="stable")]
                            cold = np.concatenate((cold, warm))
                        s, total = cold[:want], len(s)
                    else:
                        s, total = s[:want], len(s)
                    tokens.append(s)
                    sizes.append((len(s), total))
                    docs.append(doc)
                if not tokens:
                    continue
                token = np.concatenate(tokens)
                per = [a for a, _ in sizes]
                doc, n = np.repeat(np.array(docs, np.int64), per), np.repeat(np.array([b for _, b in sizes], np.int64), per)
                salt = np.zeros(len(token), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
                    parts = np.where(keys[at] == token, -(-counts[at] // SALT_AT), 1)
                    wide = np.flatnonzero(parts > 1)
                    draw = mixed(doc[wide].view(np.uint64) ^ token[wide])
                    salt[wide] = 1 + (draw % parts[wide].astype(np.uint64)).astype(np.int64)
                    # a sample of every salted part meets in one more list, which joins the parts
                    bridge = wide[(draw >> np.uint64(32)) % parts[wide].astype(np.uint64) == 0]
                    token, doc, n = np.append(token, token[bridge]), np.append(doc, doc[bridge]), np.append(n, n[bridge])
                    salt = np.append(salt, np.full(len(bridge), -1))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(doc)], names=["token", "salt", "n", "doc_id"])

    return rows.where(F.col("doc_id").isNotNull()).mapInArrow(work, "token long, salt int, n int, doc_id long")


def list_blocks(lists: DataFrame) -> DataFrame:
    """kind 0: (b1, b2, doc_id) members of blocks; kind 1: (token, n, doc_id) members of lists that
    were cut or salted, which a block may not cover."""
    schema = pa.schema([("kind", pa.int8()), ("b1", pa.int64()), ("b2", pa.int64()), ("doc_id", pa.int64())])

    def rows(kind: int, b1: np.ndarray, b2: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(b1), pa.array(b2), pa.array(doc)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        seen: set[tuple[int, int]] = set()
        forced = False  # the carried run was cut before

        def cut(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry, forced
            token, salt, n, doc = cols
            edge = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (4 * n[:-1] < 3 * n[1:])) + 1
            starts, ends = np.concatenate(([0], edge)), np.append(edge, len(token))
            if not last:  # the last run may go on
                begin = starts[-1]
                carry = [c[begin:] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            size = ends - starts
            pair = starts[(size == 2) & ~((starts == 0) & forced)]
            pair = pair[(doc[pair] != doc[pair + 1]) & (salt[pair] == 0)]
            if len(pair):
                two = np.unique(np.stack((doc[pair], doc[pair + 1]), axis=1), axis=0)
                yield rows(0, np.repeat(two[:, 0], 2), np.repeat(two[:, 1], 2), two.ravel())
            b1, b2, docs, long = [], [], [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                was = forced and s == 0
                if e - s < 2 and salt[s] == 0 and not was or e - s == 2 and salt[s] == 0 and not was:
                    continue
                if e - s > PIECE or salt[s] != 0 or was:
                    long.append((s, e))
                for at in range(s, max(s + 1, e - 1), PIECE - 1):
                    group = doc[at : min(at + PIECE, e)]
                    key = signature(group)
                    if len(group) > 1 and key not in seen:
                        seen.add(key)
                        b1.append(np.full(len(group), key[0]))
                        b2.append(np.full(len(group), key[1]))
                        docs.append(group)
            if docs:
                yield rows(0, np.concatenate(b1), np.concatenate(b2), np.concatenate(docs))
            if long:
                at = np.concatenate([np.arange(s, e) for s, e in long])
                yield rows(1, token[at], n[at], doc[at])
            if ends.size or last:
                forced = False
            if len(seen) > 1 << 20:
                seen.clear()
            if not last and len(carry[0]) > LONG_RUN:  # a long run: give out what is there but one document
                kept = [c[-1:] for c in carry]
                whole, carry = carry, None
                yield from cut(whole, True)
                yield rows(1, whole[0], whole[2], whole[3])
                carry, forced = kept, True

        for batch in batches:
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("token", "salt", "n", "doc_id")]
            if carry is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(carry, cols, strict=True)]
            if len(cols[0]):
                yield from cut(cols, False)
        if carry is not None and len(carry[0]):
            yield from cut(carry, True)

    return lists.mapInArrow(work, "kind byte, b1 long, b2 long, doc_id long")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITMAP_BITS bits with the hashed ids set; at most 2**(BITMAP_BITS - 6) words reach the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << BITMAP_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the documents named in ids, and of a few more that share their bits."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids))
    keyed = rows.where(F.col("doc_id").isNotNull()).withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            some = batch.filter(pa.array((words[bit >> 6] >> (bit & 63)) & 1 == 1))
            for part, texts in text_slices(some, limit=2 << 20):
                sets = shingle_sets(texts)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), hashes], names=["doc_id", "hashes"])

    return keyed.mapInArrow(work, "doc_id long, hashes array<long>")


def folded(bits: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bits, np.uint64)
    return words if len(words) == size else np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def feasible_forest(comps: list[int], n: list[int], bits: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest, over the known components, of the pairs of a block whose bitmaps allow a link.
    Sets come by size."""
    k = len(n)
    place: dict[int, int] = {}
    parent = [place.setdefault(c, i) for i, c in enumerate(comps)]
    roots = len(place)
    sizes = np.array(n)
    forest = []
    for q in range(k - 1):
        if roots == 1:
            break
        last = int(np.searchsorted(3 * sizes, 4 * n[q], side="right"))
        root = find(parent, q)
        some = [e for e in range(q + 1, last) if find(parent, e) != root]
        if not some:
            continue
        width = len(bits[q]) // 8  # bitmaps grow with sizes: the smaller one serves for both
        apart = np.bitwise_count(np.stack([folded(bits[e], width) for e in some]) ^ folded(bits[q], width)).sum(axis=1, dtype=np.int64)
        both = sizes[q] + sizes[some]
        for i in np.flatnonzero(apart <= both - 2 * -(-3 * both // 7)).tolist():
            a, b = find(parent, q), find(parent, some[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((q, some[i]))
                roots -= 1
    return forest


def blockwise(rows: DataFrame, columns: tuple[str, ...], edges_of: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """(u, v) from a function of each block's columns. Rows are (b1, b2, n, doc_id, ...); blocks stream by, sorted by size."""
    rows = rows.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "n", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs = None, []
        block: list[list] = [[] for _ in columns]
        out: list[tuple[int, int]] = []

        def finish() -> None:
            if len(docs) > 1:
                out.extend((docs[a], docs[b]) for a, b in edges_of(*block))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

        for batch in batches:
            values = [column_values(batch.column(c)) for c in columns]
            keys = [batch.column(c).to_numpy().tolist() for c in ("b1", "b2", "doc_id")]
            for b1, b2, doc, *row in zip(*keys, *values, strict=True):
                if (b1, b2) != key:
                    finish()
                    key, docs, block = (b1, b2), [], [[] for _ in columns]
                docs.append(doc)
                for kept, x in zip(block, row, strict=True):
                    kept.append(x)
            if out:
                yield given()
                out.clear()
        finish()
        if out:
            yield given()

    return rows.mapInArrow(work, "u long, v long")


def column_values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().tolist()
    return [flat[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]


def feasible_edges(members: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v) by bitmap for members (b1, b2, doc_id[, comp]); each document stands for its class."""
    comp = F.col("comp") if "comp" in members.columns else F.col("rep")
    rows = members.join(known, "doc_id").select("b1", "b2", "n", F.col("rep").alias("doc_id"), comp.alias("comp"), "bits")
    return blockwise(rows, ("comp", "n", "bits"), feasible_forest).where("u != v").distinct()


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def reaching(member: array, lists: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, in how many lists) of what at least `least` of the lists (ranges of `member`, each ascending)
    hold, in ascending order. When the smallest number at the heap's top is in too few lists, as many heads
    as can't make up `least` leave the heap and skip to the next top."""
    heap = [(member[lo], lo, hi) for lo, hi in lists if lo < hi]
    heapify(heap)
    while len(heap) >= least:
        number = heap[0][0]
        if least == 1:  # nothing to skip: one pass over the heap
            count = 0
            while heap and heap[0][0] == number:
                _, at, hi = heap[0]
                count += 1
                if at + 1 < hi:
                    heapreplace(heap, (member[at + 1], at + 1, hi))
                else:
                    heappop(heap)
            yield number, count
            continue
        popped = []
        while heap and heap[0][0] == number:
            popped.append(heappop(heap))
        upto = number + 1
        if len(popped) >= least:
            yield number, len(popped)
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap))
            if not heap:
                return
            upto = heap[0][0]
        for _, at, hi in popped:
            at = bisect_left(member, upto, at, hi)
            if at < hi:
                heappush(heap, (member[at], at, hi))


def block_links(comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the known components; sets come by size. Each is a query against those before it."""
    k = len(sets)
    place: dict[int, int] = {}
    parent = [place.setdefault(c, i) for i, c in enumerate(comps)]
    links: list[tuple[int, int]] = []
    if len(place) == 1:
        return links
    sizes = np.array([len(s) for s in sets])
    of = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posting = of * k + np.repeat(np.arange(k), sizes)
    posting.sort()  # inverted lists on end, each ascending
    length = np.bincount(of)
    member = array("i", (posting % k).astype(np.int32).tobytes())
    at = np.cumsum(sizes) - sizes
    apart = 0  # components among the queries so far
    for q in range(k):
        apart += parent[q] == q
        first = int(np.searchsorted(sizes, least_overlap(int(sizes[q]))))
        if apart == 1 or first >= q:
            continue
        mine = of[at[q] : at[q] + sizes[q]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        need = -(-3 * int(sizes[q] + sizes[first]) // 7)
        long = min(need - 1, int(need / (SKIP * np.log2(max(2, length[mine[-1]])) + 1)))
        short, rest = mine[: len(mine) - long], mine[len(mine) - long :] * k
        short = short[length[short] > 1] * k
        ranges = zip(np.searchsorted(posting, short + first).tolist(), np.searchsorted(posting, short + q).tolist(), strict=True)
        for e, seen in reaching(member, list(ranges), need - long):
            a, b = find(parent, e), find(parent, q)
            if a == b:
                continue
            probe = rest + e
            overlap = seen + int((posting[np.searchsorted(posting, probe).clip(max=len(posting) - 1)] == probe).sum())
            if 7 * overlap >= 3 * int(sizes[q] + sizes[e]):
                parent[max(a, b)] = min(a, b)
                links.append((e, q))
                apart -= 1
                if apart == 1:
                    break
    return links


def search(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (b1, b2, doc_id, comp) -> links (u, v) between components."""
    rows = members.join(sets, "doc_id").select("b1", "b2", F.size("hashes").alias("n"), "doc_id", "comp", "hashes")
    return blockwise(rows, ("comp", "hashes"), block_links).distinct()


def part_count(share: int = 1) -> Column:
    """Parts of a group of sets of n shingles, so that a part is about FAMILY / share documents, FAMILY_HASHES / share shingles."""
    return F.ceil(F.greatest(F.count(F.lit(1)) * share / FAMILY, F.sum("n") * share / FAMILY_HASHES))


def rest_blocks(groups: DataFrame, root: DataFrame) -> DataFrame:
    """Blocks (b1, b2, doc_id, comp) that finish large groups (g, n, doc_id): documents outside a group's
    largest component against all of the group, by classes of size (a link's sizes are in the same
    class or the next) and by hash, each side half of what a task searches at once."""
    rows = groups.join(root.select(F.col("u").alias("doc_id"), "root"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")
    open_groups = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g")
    rows = rows.join(open_groups, "g").withColumn("size_class", F.floor(F.log("n") / np.log(4 / 3)))
    main = rows.groupBy("g", "comp").count().groupBy("g").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rows = written(rows.join(main, "g"), "open-groups")
    kind = ["g", "size_class"]

    def in_parts(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(part counts, rows with their part)."""
        count = some.groupBy(*kind).agg(part_count(2).alias("parts"))
        return count, some.join(count, kind).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")

    all_count, all_rows = in_parts(rows)
    ask_count, ask_rows = in_parts(rows.where("comp != main"))
    upto = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    asked = ask_count.select("g", F.col("size_class").alias("ask_class"), upto.alias("ask_part"))
    near = F.explode(F.array(*[F.col("ask_class") + d for d in (-1, 0, 1)]))
    pairs = asked.withColumn("size_class", near).join(all_count, kind).withColumn("part", upto).drop("parts")
    key = ["g", "ask_class", "ask_part", "size_class", "part"]
    pairs = pairs.select(*key, F.xxhash64(*key).alias("b1"), F.xxhash64(F.lit(1), *key).alias("b2"))
    a = all_rows.join(pairs, [*kind, "part"]).select("b1", "b2", "doc_id", "comp")
    query = pairs.select("g", F.col("ask_class").alias("size_class"), F.col("ask_part").alias("part"), "b1", "b2")
    b = ask_rows.join(query, [*kind, "part"]).select("b1", "b2", "doc_id", "comp")
    return a.unionByName(b).distinct()


def families_searched(families: DataFrame, sets: DataFrame) -> DataFrame:
    """families (g, n, doc_id) -> links (u, v) that connect what is similar in each family."""
    parts = families.groupBy("g").agg(part_count().alias("parts"))
    rows = families.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    own = rows.select(F.col("g").alias("b1"), F.col("part").alias("b2"), "doc_id", F.col("doc_id").alias("comp"))
    # a few heads of every part meet in blocks that share a part with the next, which joins the parts of a large family
    turn = F.row_number().over(Window.partitionBy("g", "part").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))
    heads = rows.where("parts > 1").withColumn("turn", turn).where(F.col("turn") <= HEADS)
    block = -1 - F.floor(F.col("part") / CHAIN)
    blocks = F.when((F.col("part") % CHAIN == 0) & (F.col("part") > 0), F.array(block, block + 1)).otherwise(F.array(block))
    bridge = heads.select(F.col("g").alias("b1"), F.explode(blocks).alias("b2"), "doc_id", F.col("doc_id").alias("comp"))
    links = written(search(own.unionByName(bridge), sets), "links")
    large = rows.where("parts > 1").select("g", "n", "doc_id")
    if large.isEmpty():
        return links
    return links.unionByName(written(search(rest_blocks(large, connected(links)), sets), "links"))


def similar_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and link with nothing. A row with a null doc_id links with
    nothing and its component is null. Rows with the same doc_id are one document for links, each with
    its own count. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = written(document_statistics(rows), "shingle-stats")
    known = stats.where("kind = 0").select(F.col("key").alias("doc_id"), "n", "s1", "s2", "bits")
    # classes of equal sets go by their smallest document
    classes = written(known.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "shingle-classes")
    in_class = known.where("doc_id is not null").join(classes, ["n", "s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    in_class = written(in_class.select("doc_id", "n", "rep", "bits"), "shingle-classes")
    some = in_class.where("n > 0").distinct()

    lists = prefixes(rows, hot_shingles(stats)).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id")
    found = written(list_blocks(lists), "list-blocks")
    edges = written(feasible_edges(found.where("kind = 0").select("b1", "b2", "doc_id").distinct(), some), "feasible-edges")
    roots = connected(edges)
    long = found.where("kind = 1").select(F.col("b1").alias("g"), "doc_id").distinct()
    if not long.isEmpty():
        lists = long.join(some, "doc_id").select("g", "n", F.col("rep").alias("doc_id")).distinct()
        apart = rest_blocks(lists, roots)
        more = written(feasible_edges(apart, some.where("doc_id = rep")), "feasible-edges")
        if not more.isEmpty():
            roots = connected(edges.unionByName(more))
    family = written(roots.select(F.col("u").alias("doc_id"), F.col("root").alias("g")).unionByName(roots.select(F.col("root").alias("doc_id"), F.col("root").alias("g")).distinct()), "families")
    sets = written(sets_of(rows, family.select("doc_id")), "shingle-sets")
    sized = family.join(some.where("doc_id = rep").select("doc_id", "n"), "doc_id").select("g", "n", "doc_id").distinct()
    # texts that share a doc_id belong together whatever their sets
    split = in_class.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u != v").select("u", "v")
    roots = connected(families_searched(sized, sets).unionByName(split))
    same = in_class.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = known.join(same, "doc_id", "left").join(roots, F.col("rep") == F.col("u"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns unchanged. Rows that
    share a doc_id stay or go together; rows without one stay."""
    gone = similar_components(docs).where("doc_id != component_id").select(F.col("doc_id").alias("ledgerline_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["ledgerline_gone"], "left_anti")
