"""An adaptive context-mixing range coder for token ids, in independent, checksummed blocks.

A block's ids are laid out in lanes that are coded side by side, step by step, with numpy; all lanes share one model, which is
reset for each block and learns after every step. The id that followed the last two ids (order 2), or the last one (order 1),
most reliably so far is the candidate. Orders 0, 1 and 2 each give a probability that it comes next; a logistic mix with learned
weights, in integers only, drives the range coder for "it does". If it doesn't, the id is coded by order-0 frequencies.

Block: ``HEAD`` (magic, vocabulary, ids, lanes, payload bytes, crc32 of the payload, crc32 of the ids), words of each
lane (uint32 each), then the lanes' 32-bit words.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
HEAD = struct.Struct("<4sIIIIII")
MOST_LANES, LEAST_STEPS, REBUILD = 8192, 64, 8
_U = np.uint64
_S32, _M32, _TOP = _U(32), _U(0xFFFFFFFF), _U(1 << 32)
_SLOTS = 1 << 18
_GAIN = 24

#: Whole numbers as floats: what is computed of them is exact, below 2**53, and the same in encoder and decoder.
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.float64)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
_FIRST, _SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _learned(v: np.ndarray, k: np.ndarray, same: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Entries after a symbol. An entry is its candidate * 16 + confidence: a hit adds to the confidence, a miss halves it, and a
    candidate without any gives way to the symbol."""
    missed = np.where(k > 1, v - (k + 1 >> 1), fresh)
    return np.where(same, v + (k < 15), missed)


class _Model:
    """What all lanes have seen. Entries of orders 1 and 2 are gathered and put back once a step; their reliability is counted by the pair of
    confidences. Entries have 32 bits, so ids are below 2**27."""

    def __init__(self, vocab: int, lanes: int):
        if vocab > 1 << 27:
            raise ValueError(f"too large a vocabulary: {vocab}")
        self.freq, self.cum, self.total = np.ones(vocab, np.int64), np.arange(vocab + 1, dtype=np.int64), vocab
        self.of1, self.of2 = np.zeros(vocab, np.int32), np.zeros(_SLOTS, np.int32)
        self.hit1, self.all1 = np.ones(16, np.int64), np.full(16, 2, np.int64)
        self.hit2, self.all2 = np.ones(16, np.int64), np.full(16, 2, np.int64)
        self.weights = [1 << 14, 1 << 15, 1 << 15]
        self.last, self.last32, self.before32 = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.recent: list[np.ndarray] = []
        self._stretched()

    def _stretched(self) -> None:
        # The mean of 4095 parts by one multiplication with a rounded reciprocal: the same in encoder and decoder.
        self.stretch0 = _STRETCH.take((self.freq * (4095.0 / self.total)).astype(np.int64))
        self.sure = None

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and the probability of it, of 4096."""
        self.slot = ((self.last32 * _FIRST + self.before32 * _SECOND >> np.uint32(7)) & np.uint32(_SLOTS - 1)).astype(np.int64)
        self.v1, self.v2 = self.of1.take(self.last), self.of2.take(self.slot)
        self.k1, self.k2 = self.v1 & 15, self.v2 & 15
        self.c1, self.c2 = self.v1 >> 4, self.v2 >> 4
        self.cand = np.where(self.k2 > 0, self.c2, self.c1)
        self.both = (np.where(self.c1 == self.cand, self.k1 << 4, 0) | self.k2).astype(np.int64)
        self.s0 = self.stretch0.take(self.cand)
        self.s1, self.s2 = _STRETCH[self.hit1 * 4095 // self.all1], _STRETCH[self.hit2 * 4095 // self.all2]
        w0, w1, w2 = self.weights
        of_both = np.add.outer(self.s1 * w1, self.s2 * w2).ravel() / 65536 + 2047
        # Cutting off goes up below zero, where the clip makes all the same.
        self.p = _SQUASH.take((self.s0 * (w0 / 65536) + of_both.take(self.both)).astype(np.int64), mode="clip")
        return self.cand, self.p

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """``ids``: of each lane, 64 bits wide."""
        n = len(ids)
        error = np.where(hit, 4096.0, 0.0)
        error -= self.p
        counts = np.bincount((self.both << 1) + hit, minlength=512).reshape(16, 16, 2)
        every, hits = counts.sum(axis=2), counts[:, :, 1]
        off = np.bincount(self.both, weights=error, minlength=256).reshape(16, 16)
        moves = int(np.dot(error, self.s0)), int(np.dot(off.sum(axis=1), self.s1)), int(np.dot(off.sum(axis=0), self.s2))
        self.weights = [w + m // (n << 9) for w, m in zip(self.weights, moves)]
        self.all1 += every.sum(axis=1)
        self.hit1 += hits.sum(axis=1)
        self.all2 += every.sum(axis=0)
        self.hit2 += hits.sum(axis=0)
        narrow = ids.astype(np.int32)
        fresh = narrow << 4 | 1
        self.of1[self.last] = _learned(self.v1, self.k1, self.c1 == narrow, fresh)
        self.of2[self.slot] = _learned(self.v2, self.k2, self.c2 == narrow, fresh)
        self.recent.append(ids)
        if len(self.recent) == REBUILD:
            self.freq += _GAIN * np.bincount(np.concatenate(self.recent), minlength=len(self.freq))
            self.recent = []
            np.cumsum(self.freq, out=self.cum[1:])
            self.total = int(self.cum[-1])
            self._stretched()
        self.last, self.before32, self.last32 = ids, self.last32, narrow.view(np.uint32)

    def symbols(self, v: np.ndarray) -> np.ndarray:
        """The symbols whose shares of the total hold ``v``. Most stretches of the total lie in one symbol's share; others are searched."""
        if self.sure is None:
            self.shift = max(0, self.total.bit_length() - 15)
            first = np.searchsorted(self.cum, np.arange(0, self.total + (1 << self.shift), 1 << self.shift), side="right") - 1
            self.sure = np.where(first[1:] == first[:-1], first[:-1], -1)
        x = self.sure.take(v >> self.shift)
        rest = np.flatnonzero(x < 0)
        x[rest] = np.searchsorted(self.cum, v[rest], side="right") - 1
        return x


class _Encoder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _U(2**64 - 1))
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def _put(self, low: np.ndarray, rng: np.ndarray, at: np.ndarray | None) -> None:
        """Give out a word of each lane (of ``at``) whose range has become small."""
        small = np.flatnonzero(rng < _TOP)
        if len(small):
            lo, ra = low[small], rng[small]
            # A range across a word's edge is cut at the edge, so the word can be written for good.
            ra = np.where((lo >> _S32) != ((lo + ra - _U(1)) >> _S32), _TOP - (lo & _M32), ra)
            self.lanes.append((small if at is None else at[small]).astype(np.uint16))
            self.words.append((lo >> _S32).astype("<u4"))
            low[small], rng[small] = lo << _S32, ra << _S32

    def bit(self, p: np.ndarray, hit: np.ndarray) -> None:
        """Narrow all lanes to the first ``p`` of 4096 parts or, without a hit, to the others."""
        r = self.range >> _TWELVE
        part = r * p
        self.low = self.low + np.where(hit, _U(0), part)
        self.range = np.where(hit, part, (r << _TWELVE) - part)
        self._put(self.low, self.range, None)

    def code(self, at: np.ndarray, start: np.ndarray, size: np.ndarray, total: int) -> None:
        """Narrow the lanes ``at`` to ``size`` of ``total`` parts from ``start``."""
        r = self.range[at] // _U(total)
        low, rng = self.low[at] + r * start, r * size
        self._put(low, rng, at)
        self.low[at], self.range[at] = low, rng

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.low)
        self.lanes.append(np.arange(n, dtype=np.uint16))
        self.words.append(((self.low >> _S32) + ((self.low & _M32) != 0)).astype("<u4"))
        lanes = np.concatenate(self.lanes)
        return np.bincount(lanes, minlength=n).astype("<u4"), np.concatenate(self.words)[np.argsort(lanes, kind="stable")]


class _Decoder:
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        n = len(counts)
        self.low, self.range = np.zeros(n, _U), np.full(n, _U(2**64 - 1))
        self.words = np.concatenate([words, np.zeros(2, "<u4")]).astype(_U)
        self.at = np.cumsum(counts, dtype=np.int64) - counts
        self.end = self.at + counts
        self.value = (self._next(slice(None)) << _S32) | self._next(slice(None))

    def _next(self, lanes) -> np.ndarray:
        at = self.at[lanes]
        word = np.where(at < self.end[lanes], self.words[np.minimum(at, len(self.words) - 1)], _U(0))
        self.at[lanes] = at + 1
        return word

    def _take(self, low: np.ndarray, rng: np.ndarray, at: np.ndarray | None) -> None:
        small = np.flatnonzero(rng < _TOP)
        if len(small):
            lo, ra = low[small], rng[small]
            ra = np.where((lo >> _S32) != ((lo + ra - _U(1)) >> _S32), _TOP - (lo & _M32), ra)
            low[small], rng[small] = lo << _S32, ra << _S32
            lanes = small if at is None else at[small]
            self.value[lanes] = (self.value[lanes] << _S32) | self._next(lanes)

    def bit(self, p: np.ndarray) -> np.ndarray:
        """Whether each lane has a hit."""
        r = self.range >> _TWELVE
        part = r * p
        hit = self.value - self.low < part
        self.low = self.low + np.where(hit, _U(0), part)
        self.range = np.where(hit, part, (r << _TWELVE) - part)
        self._take(self.low, self.range, None)
        return hit

    def decode(self, at: np.ndarray, model: _Model) -> np.ndarray:
        """The symbols of the lanes ``at``."""
        r, low = self.range[at] // _U(model.total), self.low[at]
        x = model.symbols(np.minimum((self.value[at] - low) // r, _U(model.total - 1)).view(np.int64))
        low, rng = low + r * model.cum.take(x).view(_U), r * model.freq.take(x).view(_U)
        self._take(low, rng, at)
        self.low[at], self.range[at] = low, rng
        return x


_TWELVE = _U(12)


def _turned(grid: np.ndarray) -> np.ndarray:
    """Rows as columns, in squares that stay in the cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, grid.shape[0], 64):
        for b in range(0, grid.shape[1], 64):
            out[b : b + 64, a : a + 64] = grid[a : a + 64, b : b + 64].T
    return out


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // LEAST_STEPS))
    steps = -(-n // lanes)
    lanes = -(-n // steps) if n else 1
    grid = np.zeros((lanes, steps), np.uint32)
    grid.ravel()[:n] = ids
    columns = _turned(grid)
    model, coder = _Model(vocab, lanes), _Encoder(lanes)
    for s in columns:
        cand, p = model.predict()
        s = s.astype(np.int64)
        hit = s == cand
        coder.bit(p.view(_U), hit)
        miss = np.flatnonzero(~hit)
        if len(miss):
            x = s[miss]
            coder.code(miss, model.cum.take(x).view(_U), model.freq.take(x).view(_U), model.total)
        model.update(s, hit)
    counts, words = coder.finish()
    payload = counts.tobytes() + words.tobytes()
    return HEAD.pack(MAGIC, vocab, n, lanes, len(payload), zlib.crc32(payload), zlib.crc32(np.asarray(ids, "<u4").tobytes())) + payload


class CorruptBlock(ValueError):
    """A block's checksum, magic or length does not fit."""


def decode_block(block: bytes) -> np.ndarray:
    """The ids (uint32) of one block."""
    if len(block) < HEAD.size:
        raise CorruptBlock("the block has no whole head")
    magic, vocab, n, lanes, size, crc, ids_crc = HEAD.unpack_from(block)
    payload = block[HEAD.size : HEAD.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
        raise CorruptBlock("the block's checksum does not fit")
    counts = np.frombuffer(payload, "<u4", lanes)
    coder, model = _Decoder(counts.astype(np.int64), np.frombuffer(payload, "<u4", offset=4 * lanes)), _Model(vocab, lanes)
    steps = -(-n // lanes)
    out = np.zeros((steps, lanes), np.uint32)
    for t in range(steps):
        cand, p = model.predict()
        hit = coder.bit(p.view(_U))
        miss = np.flatnonzero(~hit)
        s = cand.astype(np.int64)
        if len(miss):
            s[miss] = coder.decode(miss, model)
        out[t] = s
        model.update(s, hit)
    ids = _turned(out).ravel()[:n].astype("<u4", copy=False)
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise CorruptBlock("the ids' checksum does not fit")
    return ids
