"""Token ids in binary files, coded with static rANS.

Texts are range-partitioned by doc_id and sorted inside the partition; each task tokenizes its
range and writes files of about `roll_bytes`. A file is a run of segments of bounded size; a segment
holds the document index, one frequency table made from all its ids, and the coded blocks, each with
its coder states (a checkpoint to decode from) and checksum. Files come back through Spark's binaryFile
source. The whole order is (file number, position): file numbers follow the ranges. A task holds one
file at most; rows of one doc_id, or of none, are written by one task, file after file.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, slices, written
from .files import make_dir, write_file
from .rans import Table, decode_blocks, encode_segment

MAGIC = b"RTOK0001"
SEGMENT = struct.Struct("<QQQQQ")  # documents, ids, bytes of index, of table, of blocks
SEGMENT_IDS = 2 << 20
#: File numbers of one task: number = task * FILES + place.
FILES = 1_000_000
END_ID = 2
#: What else than a space counts as blank in byte-level BPE or in Python.
OTHER_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Marks the first piece of a text, which has no space before it; a line break marks itself.
HEAD = "\0"
HEADS = "\0\n"
#: Marks at the end of a word; the apostrophe isn't one, since contractions are pre-tokens.
MARKS = ".,;:!?$%&*#"


def splits_at_spaces(text: str) -> bool:
    """Whether all spaces of the text stand alone between solid characters. A byte-level BPE begins a
    new pre-token at each such space, so what lies between them can be encoded apart."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or "\r" in text or HEAD in text:
        return False
    return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_BLANKS)


def splits_at_breaks(text: str) -> bool:
    """The same for line breaks: a lone one is a pre-token of its own."""
    if "\n\n" in text or text[:1] == "\n" or text[-1:] == "\n":
        return False
    return not any(c != "\n" and c in text and (f"\n{c}" in text or f"{c}\n" in text) for c in OTHER_BLANKS)


def pieces_of(text: str) -> list[str]:
    """The text cut before spaces, which go, and before line breaks, which stay."""
    return (text.replace("\n", " \n") if "\n" in text and splits_at_breaks(text) else text).split(" ")


class PieceEncoder:
    """The library's encoding of whole texts, piece by piece with the pieces seen before kept."""

    def __init__(self, path: str, room: int = 1_200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits = self.tokenizer.normalizer is None and repr(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in repr(self.tokenizer.pre_tokenizer)
        model = self.tokenizer.model
        model._resize_cache(0)  # pieces are remembered here
        self.tokenizer.model = model
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # begins with a space
        self.breaks = np.zeros(size, bool)
        self.breaks[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        self.tails: dict[str, bytes] = {}
        # two generations: what is used moves to the young one, and the old one goes when that is full
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = room // 2

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def recalled(self, pieces: set[str]) -> None:
        """Move what the old generation knows of the pieces to the young one."""
        if again := self.old.keys() & pieces:
            self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))

    def learn(self, new: set[str]) -> None:
        """Encode the pieces. Those behind spaces go many in one text: each begins at its only id with a space."""
        known = self.known
        self.recalled(new)
        new = new.difference(known)
        # behind a Latin letter a run of marks is a pre-token of its own
        stem_of = {w: stem for w in new if w[-1] in MARKS and len(stem := w.rstrip(MARKS)) > 1 and stem[-1].isalpha() and stem[-1] < "\u0250"}
        stems = set(stem_of.values())
        self.recalled(stems)
        pieces = list((new.difference(stem_of) | stems).difference(known))
        self.together([w for w in pieces if w[0] not in HEADS], " ", self.opens)
        self.together([w[1:] for w in pieces if w[0] == "\n"], "\n", self.breaks)
        first = [w for w in pieces if w[0] == HEAD]
        known.update(zip(first, self.whole([w[1:] for w in first]), strict=True))
        tails = {w: w[len(stem) :] for w, stem in stem_of.items()}
        if missing := list(set(tails.values()).difference(self.tails)):
            self.tails.update(zip(missing, self.whole(missing), strict=True))
        for w, stem in stem_of.items():
            known[w] = known[stem] + self.tails[tails[w]]

    def together(self, pieces: list[str], before: str, starts: np.ndarray) -> None:
        """Encode pieces a thousand in a text, `before` in front of each: each begins at its only id in `starts`."""
        name = before.strip(" ")
        runs = [pieces[i : i + 1000] for i in range(0, len(pieces), 1000)]
        for run, raw in zip(runs, self.whole([before + before.join(run) for run in runs]), strict=True):
            at = (np.flatnonzero(starts[np.frombuffer(raw, np.uint32)]) * 4).tolist()
            self.known.update([(name + w, raw[a:b]) for w, a, b in zip(run, at, [*at[1:], len(raw)], strict=True)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts on end, the number of each)."""
        if len(self.known) > self.room:
            self.known, self.old = {}, self.known
        if len(self.tails) > self.room:
            self.tails = {}
        pieces = [pieces_of(t) if self.splits and splits_at_spaces(t) and not any(s in t for s in self.special) else [t] for t in texts]
        for p in pieces:
            p[0] = HEAD + p[0]
        if new := set().union(*pieces).difference(self.known):
            self.learn(new)
        given = self.known.__getitem__
        whole = [b"".join(map(given, p)) for p in pieces]
        return np.frombuffer(b"".join(whole), np.uint32), np.fromiter(map(len, whole), np.int64, len(whole)) // 4


def with_ends(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id behind each document."""
    out = np.empty(len(ids) + len(sizes), np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    out[np.cumsum(sizes + 1) - 1] = end_id
    return out, sizes + 1


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, room: int) -> PieceEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, room)
    return _encoders[path]


def packed_segment(ids: np.ndarray, sizes: np.ndarray, docs: list[int | None]) -> list[bytes]:
    lengths = sizes.astype("<u4")
    numbers = np.array([d if d is not None else 0 for d in docs], "<i8")
    nulls = np.packbits(np.array([d is None for d in docs], bool))
    table, blocks = encode_segment(ids)
    index = zlib.compress(lengths.tobytes() + numbers.tobytes() + nulls.tobytes(), 1)
    sizes = np.array([len(b) for b in blocks], "<u4").tobytes()
    body = len(sizes) + sum(map(len, blocks))
    return [SEGMENT.pack(len(docs), int(lengths.sum()), len(index), len(table), body), index, table, sizes, *blocks]


def unpacked(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids per document, all ids) of each segment."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    while at < len(data):
        docs, total, index_size, table_size, body = SEGMENT.unpack_from(data, at)
        at += SEGMENT.size
        index = zlib.decompress(data[at : at + index_size])
        lengths = np.frombuffer(index, "<u4", docs)
        numbers = np.frombuffer(index, "<i8", docs, 4 * docs).tolist()
        nulls = np.unpackbits(np.frombuffer(index, np.uint8, -1, 12 * docs), count=docs).tolist()
        at += index_size
        table = Table(data[at : at + table_size])
        at += table_size
        count = -(-total // (256 * 256)) if total else 0
        sizes = np.frombuffer(data, "<u4", count, at).tolist()
        pos, blocks = at + 4 * count, []
        for size in sizes:
            blocks.append(data[pos : pos + size])
            pos += size
        at += body
        ids = np.concatenate([*decode_blocks(table, blocks), np.empty(0, np.uint32)]) if blocks else np.empty(0, np.uint32)
        yield [None if gone else d for d, gone in zip(numbers, nulls, strict=True)], lengths, ids.astype(np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, room: int = 1_200_000, keep: bool = True, roll_bytes: int = 64 << 20, segment_ids: int | None = None) -> DataFrame:
    """Write the files; a lazy manifest (file, docs, ids, bytes), whose evaluation writes them.

    A null text is empty: its document holds the end id alone. A null doc_id sorts first and stays
    null; repeated ids are written each, in the order of their texts' hashes; other columns are not
    read; an empty table writes no file. `room` bounds the pieces that a worker remembers and `segment_ids`
    the ids that it codes together; without `keep` it takes texts in smaller slices and lets pieces and
    tokenizer go behind each task, for less memory and more work.
    """
    make_dir(folder)
    segment_ids = segment_ids or SEGMENT_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer, room)
        parts, total, count, number = [MAGIC], 0, 0, part * FILES
        held: list[tuple[np.ndarray, np.ndarray, list[int | None]]] = []

        def flush() -> None:
            nonlocal total, count
            ids, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            docs = [d for h in held for d in h[2]]
            held.clear()
            parts.extend(packed_segment(ids, sizes, docs))
            total, count = total + len(ids), count + len(sizes)

        def rolled() -> pa.RecordBatch:
            nonlocal parts, total, count, number
            size = write_file(folder, f"tokens-{number:012d}.rtok", parts)
            row = {"file": number, "docs": count, "ids": total, "bytes": size}
            parts, total, count, number = [MAGIC], 0, 0, number + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for piece in slices(batch, limit=(4 if keep else 1) << 20):
                coded = coder.encode(piece.column("text").to_pylist())
                held.append((*with_ends(*coded, end_id), piece.column("doc_id").to_pylist()))
                if sum(len(h[0]) for h in held) >= segment_ids:
                    flush()
                if count and sum(map(len, parts)) >= roll_bytes:
                    yield rolled()
            batch = piece = coded = None  # nothing of it stays while the next one comes
        if held:
            flush()
        if count:
            yield rolled()
        if not keep:
            del coder
            _encoders.clear()
            gc.collect()
        give_back()

    return rows.mapInArrow(work, "file long, docs long, ids long, bytes long")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(file, position, doc_id, local_start, n_tokens, ids_crc32, ids) of every document of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rtok").load(folder).select("path", "content")
    schema = "file long, position long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                number = int(re.search(r"tokens-(\d+)\.rtok$", path)[1])
                position = start = 0
                for docs, lengths, values in unpacked(content.as_py()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw = memoryview(values.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    columns = {
                        "file": pa.array([number] * len(docs), pa.int64()), "position": pa.array(np.arange(position, position + len(docs))),
                        "doc_id": pa.array(docs, pa.int64()), "local_start": pa.array(start + ends - lengths), "n_tokens": pa.array(lengths.astype(np.int64)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
                    position, start = position + len(docs), start + int(ends[-1]) if len(ends) else start

    return files.mapInArrow(work, schema)


def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before.

    One row per file goes through a single window; documents never do.
    """
    rows = written(read_tokens(spark, folder, ids=False), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    base = files.select("file", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file")) - F.col("n")).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
