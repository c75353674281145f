"""Range asymmetric numeral systems over token ids, many interleaved lanes at a time with numpy.

A segment shares one frequency table. Its ids fall into blocks; each block is coded by LANES
interleaved coders of 64-bit state that renormalise by 32 bits, and stores its own final states, so
blocks decode apart from each other, in any order. All lanes of all blocks of a segment advance in
one numpy step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 256
STEPS = 256  # tokens of a lane in a full block
LOW = np.uint64(1 << 31)
SHIFT = np.uint64(32)
BLOCK = struct.Struct("<IIII")  # ids, steps, 32-bit words, crc32 of states and words


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of the present symbols, 1 at least, that add up to 2**bits."""
    total = 1 << bits
    freq = np.maximum(1, counts * total // counts.sum())
    gap = int(total - freq.sum())
    if gap > 0:
        freq[np.argmax(counts)] += gap
    order = np.argsort(-freq, kind="stable")
    while gap < 0:  # what rounding up the rare symbols added comes off the frequent ones
        room = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 8))
        take = np.minimum(room, np.maximum(0, -gap - (np.cumsum(room) - room)))
        freq[order] -= take
        gap += int(take.sum())
    return freq


def table_bits(distinct: int) -> int:
    return max(12, min(22, int(distinct).bit_length() + 2))


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """(packed table, blocks) of one segment's ids."""
    if not len(ids):
        return zlib.compress(struct.pack("<II", 12, 0)), []
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int32)
        place[symbols] = np.arange(len(symbols))
        index, counts = place[ids], counts[symbols]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = table_bits(len(symbols))
    freq = scaled(counts.astype(np.int64), bits)
    table = struct.pack("<II", bits, len(symbols)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    size = LANES * STEPS
    full = len(ids) // size
    blocks = []
    if full:
        blocks += _encode(index[: full * size].reshape(full, STEPS, LANES), freq, start, bits, [size] * full)
    if tail := len(ids) - full * size:
        steps = -(-tail // LANES)
        padded = np.full(steps * LANES, int(np.argmax(freq)), index.dtype)
        padded[:tail] = index[full * size :]
        blocks += _encode(padded.reshape(1, steps, LANES), freq, start, bits, [tail])
    return zlib.compress(table), blocks


def _encode(index: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int, sizes: list[int]) -> list[bytes]:
    blocks, steps, lanes = index.shape
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    state = np.full(blocks * lanes, LOW, np.uint64)
    words = np.zeros((steps, blocks * lanes), np.uint32)
    out = np.zeros((steps, blocks * lanes), bool)
    for t in range(steps - 1, -1, -1):
        s = index[:, t, :].ravel()
        f = freq[s]
        emit = state >= (f << room)
        out[t] = emit
        words[t] = state.astype(np.uint32)
        state = np.where(emit, state >> SHIFT, state)
        whole = state // f
        state = (whole << shift) + (state - whole * f) + start[s]
    words = words.reshape(steps, blocks, lanes).transpose(1, 0, 2)
    out = out.reshape(steps, blocks, lanes).transpose(1, 0, 2)
    coded = []
    for b in range(blocks):
        stream = words[b][out[b]].astype("<u4").tobytes()
        body = state[b * lanes : (b + 1) * lanes].astype("<u8").tobytes() + stream
        coded.append(BLOCK.pack(sizes[b], steps, len(stream) // 4, zlib.crc32(body)) + body)
    return coded


class Table:
    def __init__(self, packed: bytes) -> None:
        raw = zlib.decompress(packed)
        self.bits, n = struct.unpack_from("<II", raw)
        self.symbols = np.frombuffer(raw, "<u4", n, 8)
        freq = np.frombuffer(raw, "<u4", n, 8 + 4 * n).astype(np.int64)
        self.of_slot = np.repeat(np.arange(n, dtype=np.int32), freq)
        self.freq = np.repeat(freq.astype(np.uint32), freq)
        self.bias = (np.arange(len(self.of_slot)) - np.repeat(np.cumsum(freq) - freq, freq)).astype(np.uint32)


def decode_blocks(table: Table, blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; blocks of equal steps decode side by side. A damaged block raises."""
    heads = [BLOCK.unpack_from(b) for b in blocks]
    for (_, _, _, crc), b in zip(heads, blocks, strict=True):
        if zlib.crc32(memoryview(b)[BLOCK.size :]) != crc:
            raise ValueError("checksum of a token block fails")
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    for steps in sorted({h[1] for h in heads}):
        some = [i for i, h in enumerate(heads) if h[1] == steps]
        for i, ids in zip(some, _decode(table, [blocks[i] for i in some], steps, [heads[i] for i in some]), strict=True):
            out[i] = ids
    return out


def _decode(table: Table, blocks: list[bytes], steps: int, heads: list[tuple]) -> list[np.ndarray]:
    n = len(blocks)
    state = np.concatenate([np.frombuffer(b, "<u8", LANES, BLOCK.size) for b in blocks]).astype(np.uint64)
    words = np.concatenate([*(np.frombuffer(b, "<u4", h[2], BLOCK.size + 8 * LANES) for b, h in zip(blocks, heads, strict=True)), np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum([0, *(h[2] for h in heads)])[:-1]
    shift, slots = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    found = np.empty((steps, n * LANES), np.int32)
    for t in range(steps):
        slot = (state & slots).astype(np.int64)
        found[t] = table.of_slot[slot]
        state = table.freq[slot] * (state >> shift) + table.bias[slot]
        read = state < LOW
        grid = read.reshape(n, LANES)
        order = np.cumsum(grid, axis=1)
        pos = (at[:, None] + order - 1).ravel()[read]
        state[read] = (state[read] << SHIFT) | words[pos]
        at = at + order[:, -1]
    ids = table.symbols[found].reshape(steps, n, LANES).transpose(1, 0, 2).reshape(n, steps * LANES)
    return [ids[i, : heads[i][0]] for i in range(n)]
