"""Blocks of token ids by adaptive context mixing, the second format (``CMR2``): smaller than ``id_coder``'s, in half the time.

A block's ids are laid out in lanes that are coded side by side, step by step, with numpy; all lanes share one model, which is
reset for each block and learns as it goes. The id that followed the last two ids (order 2), or the last one (order 1), most reliably so far is
the candidate. Orders 0, 1 and 2 each give a probability that it comes next; a logistic mix with learned weights, averaged with
what came of the same evidence so far, drives the coder for "it does". If it doesn't, the id is coded by the block's own frequencies.

Against the first format: ids are numbered within the block, and their frequencies are sent with it instead of learned; lanes are states of an
asymmetric numeral system in 32 bits, whose words lie in one stream in the order of reading, so nothing is kept by lane; mixed probabilities are
looked up by the evidence (order 0's in steps of a power of two) and worked out anew now and then, in integers only.

Block: ``HEAD`` as in ``id_coder``, then the payload: bytes of the table (uint32), the table, zlib-packed (numbers of ids, their differences in ascending order as
uint32, their shares of 65536 as uint16, 0: rare), the lanes' states (uint32), the words (uint16). A rare id is coded as such, then by its
number among the rare ones, in equal shares.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

from .id_coder import HEAD, CorruptBlock, _turned

MAGIC = b"CMR2"
MOST_LANES, LEAST_STEPS = 8192, 64
_LEARN = 1 << 17  # most ids between two mixes
_SLOTS_BITS = 18
_TOP = 1 << 14  # ids with shares of their own
_ALL = 1 << 16
_DENSE = 1 << 24  # ids below are numbered by counting
_U32 = np.uint32
_12, _16, _20, _LOW12, _LOW16 = (_U32(x) for x in (12, 16, 20, 4095, 65535))
_FIRST, _SECOND, _DOWN = _U32(0x9E3779B1), _U32(0x85EBCA6B), _U32(32 - _SLOTS_BITS)

_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Shares of 65536 of the ids with the given counts, with at least one left over; 0: rare."""
    n, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not n:
        return out
    own = np.flatnonzero(counts * _ALL >= n)
    if not len(own):
        own = np.array([np.argmax(counts)])
    if len(own) > _TOP:
        own = np.sort(own[np.argsort(-counts[own], kind="stable")[:_TOP]])
    out[own] = 1 + counts[own] * (_ALL - 1 - len(own)) // n
    rare = n - int(counts[own].sum())
    out[own[np.argmax(out[own])]] += _ALL - 1 - int(out.sum()) - rare * (_ALL - 1 - len(own)) // n
    return out


def _mask(flags: np.ndarray, kind: np.dtype) -> np.ndarray:
    """All bits where a flag is set. ``np.where`` branches by element, several times slower where flags are mixed."""
    return -flags.astype(kind)


def _either(flags: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """``yes`` where a flag is set, else ``no``."""
    out = yes ^ no
    out &= _mask(flags, out.dtype)
    out ^= no
    return out


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places, all of which exist: without the check for each, which takes half the time."""
    return values.take(places, mode="clip")


def _part(p: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the part of 4096: the first ``p`` for a hit, the others without one."""
    missed = hit.astype(_U32) - _U32(1)
    return p & missed, (p ^ missed) + (missed & _U32(4097))


class _Frequencies:
    """The block's own frequencies. Symbols are numbers of ids; behind them one stands for all that are rare."""

    def __init__(self, shares: np.ndarray):
        self.n = len(shares)
        if self.n > 1 << 27:
            raise ValueError(f"too many different ids: {self.n}")
        # Of an entry: four bits of confidence besides the symbol. Half as wide takes half the time and stays in the cache.
        self.kind = np.dtype(np.uint16 if self.n < 1 << 12 else _U32)
        rest = _ALL - int(shares.sum())
        freq = np.append(shares, rest)
        self.part = (np.cumsum(freq) - freq << 16 | freq & 0xFFFF).astype(_U32)  # start and share, looked up at once
        self.symbol = np.repeat(np.arange(self.n + 1, dtype=self.kind), freq)
        self.rare = np.flatnonzero(shares == 0)
        self.place = np.zeros(self.n, np.int64)
        self.place[self.rare] = np.arange(len(self.rare))
        # A rare id's number goes in digits of at most 16 bits.
        bits = max(0, len(self.rare) - 1).bit_length()
        self.digits = [(at, min(16, bits - at)) for at in range(0, bits, 16)]
        # Order 0's evidence: how many bits the share has, at a candidate's own place in the tables below.
        self.level = np.minimum(15, np.frexp(shares.astype(np.float64))[1]).astype(self.kind) << 8


class _Model:
    """What all lanes have seen. An entry is its candidate * 16 + confidence: a hit adds to the confidence, a miss halves it, and a candidate
    without any gives way to the symbol. ``evidence`` of a candidate: order 0's level, order 1's confidence if it says the same, order 2's."""

    def __init__(self, frequencies: _Frequencies, lanes: int):
        self.level, kind = frequencies.level, frequencies.kind
        self.of1, self.of2 = np.zeros(frequencies.n, kind), np.zeros(1 << _SLOTS_BITS, kind)
        self.hits, self.every = np.zeros((16, 16, 16), np.int64), np.zeros((16, 16, 16), np.int64)
        self.s0 = _STRETCH[[1 << k >> 5 for k in range(16)]][:, None, None]
        self.weights = [1 << 14, 1 << 15, 1 << 15]
        self.last, self.before, self.turned = np.zeros(lanes, np.int64), np.zeros(lanes, _U32), np.zeros(lanes, _U32)
        self.recent: list[np.ndarray] = []
        self.steps, self.most = 0, max(1, _LEARN // lanes)
        self._mix()

    def _mix(self) -> None:
        """The probability, of 4096, of each evidence."""
        hits, every = self.hits.sum(axis=0), self.every.sum(axis=0)
        self.s1 = _STRETCH[(hits.sum(axis=1) + 1) * 4095 // (every.sum(axis=1) + 2)][:, None]
        self.s2 = _STRETCH[(hits.sum(axis=0) + 1) * 4095 // (every.sum(axis=0) + 2)]
        w0, w1, w2 = self.weights
        self.mixed = _SQUASH.take((self.s0 * w0 + (self.s1 * w1 + self.s2 * w2) >> 16) + 2047, mode="clip")
        # The mix counts as sixteen cases besides those of the evidence itself.
        p = (self.hits * 4096 + self.mixed * 16) // (self.every + 16)
        self.table = np.minimum(np.maximum(p, 1), 4095).ravel().astype(_U32)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and the probability of it, of 4096."""
        self.slot = (self.turned + self.before >> _DOWN).astype(np.int64)
        self.v1, self.v2 = _at(self.of1, self.last), _at(self.of2, self.slot)
        self.k1, self.k2 = self.v1 & 15, self.v2 & 15
        self.c1, self.c2 = self.v1 >> 4, self.v2 >> 4
        cand = _either(self.k2 > 0, self.c2, self.c1)
        self.evidence = _at(self.level, cand)
        self.evidence |= self.k2
        self.evidence |= self.k1 << 4 & _mask(self.c1 == cand, self.k1.dtype)
        return cand, _at(self.table, self.evidence)

    def update(self, s: np.ndarray, hit: np.ndarray) -> None:
        fresh = s << 4 | 1
        self.of1[self.last] = _learned(self.v1, self.k1, self.c1 == s, fresh)
        self.of2[self.slot] = _learned(self.v2, self.k2, self.c2 == s, fresh)
        self.evidence += hit.astype(s.dtype) << 12
        self.recent.append(self.evidence)
        self.steps += 1
        if len(self.recent) >= min(self.most, 1 + self.steps // 8):
            self._learn()
        self.last = s.astype(np.int64)
        self.before, self.turned = self.turned * _SECOND, s.astype(_U32) * _FIRST

    def _learn(self) -> None:
        cases = np.concatenate(self.recent)
        missed, hits = np.bincount(cases, minlength=8192).reshape(2, 16, 16, 16)
        every = hits + missed
        self.recent = []
        self.hits += hits
        self.every += every
        error = hits * 4096 - every * self.mixed
        both = error.sum(axis=0)
        moves = int((error.sum(axis=(1, 2)) * self.s0.ravel()).sum()), int((both.sum(axis=1) * self.s1.ravel()).sum()), int((both.sum(axis=0) * self.s2).sum())
        self.weights = [w + m // (len(cases) << 7) for w, m in zip(self.weights, moves)]
        self._mix()


def _learned(v: np.ndarray, k: np.ndarray, same: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Entries after a symbol."""
    missed = _either(k > 1, v - (k + 1 >> 1), fresh)
    return _either(same, v + (k < 15), missed)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that come, ascending, their counts, and each id's number among them."""
    if len(ids) and int(ids.max()) >= _DENSE:
        used, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return used, counts, numbers.astype(np.int32)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    return used, counts[used], number.take(ids) if len(ids) else np.zeros(0, np.int32)


def _times(states: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whole quotients: below 2**32 a quotient of floats is cut to the right one."""
    return (states / size).astype(_U32)


def _put(states: np.ndarray, size: np.ndarray, shift: np.uint32, words: list[np.ndarray]) -> None:
    """Give out a word of each state that is too large for ``size`` of the parts."""
    large = np.flatnonzero(states >= size << shift)
    if len(large):
        high = states[large]
        words.append((high & _LOW16).astype("<u2"))
        states[large] = high >> _16


def encode(ids: np.ndarray, vocab: int) -> bytes:
    """The block of the given ids, each below ``vocab``."""
    if vocab > 1 << 27:
        raise ValueError(f"too large a vocabulary: {vocab}")
    n = len(ids)
    lanes = max(1, min(MOST_LANES, n // LEAST_STEPS))
    steps = -(-n // lanes)
    lanes = -(-n // steps) if n else 1
    used, counts, numbers = _numbered(ids)
    shares = _shares(counts)
    frequencies = _Frequencies(shares)
    grid = np.zeros((lanes, steps), frequencies.kind)
    grid.ravel()[:n] = numbers
    model, made = _Model(frequencies, lanes), []
    for s in _turned(grid):
        cand, p = model.predict()
        hit = s == cand
        miss = np.flatnonzero(~hit)
        made.append((hit, p, miss.astype(np.uint16), s[miss]))
        model.update(s, hit)
    states, words = np.full(lanes, _ALL, _U32), []
    # A state gives back last what it took in first.
    while made:
        hit, p, miss, s = made.pop()
        if len(miss):
            _code(states, miss, s, frequencies, words)
        start, size = _part(p, hit)
        _put(states, size, _20, words)
        states += _times(states, size) * (_U32(4096) - size)
        states += start
    table = zlib.compress(np.uint32(len(used)).tobytes() + np.diff(used, prepend=0).astype("<u4").tobytes() + shares.astype("<u2").tobytes(), 6)
    payload = b"".join([np.uint32(len(table)).tobytes(), table, states.astype("<u4").tobytes(), *(w.tobytes() for w in reversed(words))])
    return HEAD.pack(MAGIC, vocab, n, lanes, len(payload), zlib.crc32(payload), zlib.crc32(np.asarray(ids, "<u4").tobytes())) + payload


def _code(states: np.ndarray, miss: np.ndarray, s: np.ndarray, f: _Frequencies, words: list[np.ndarray]) -> None:
    """Take the symbols of the lanes ``miss`` into their states."""
    part = _at(f.part, s)
    if len(f.rare):
        rare = np.flatnonzero((part & _LOW16) == 0)
        if len(rare):
            at, place = miss[rare], f.place.take(s[rare])
            x = states[at]
            for low, bits in f.digits:
                _put(x, np.ones(len(x), _U32), _U32(32 - bits), words)
                x = (x << _U32(bits)) + (place >> low & (1 << bits) - 1).astype(_U32)
            states[at] = x
            part[rare] = f.part[f.n]
    x, size = states[miss], part & _LOW16
    _put(x, size, _16, words)
    x += _times(x, size) * (_U32(_ALL) - size)
    x += part >> _16
    states[miss] = x


class _Words:
    """Words of a block in the order of reading."""

    def __init__(self, words: np.ndarray):
        self.words, self.at = words, 0

    def fill(self, states: np.ndarray) -> None:
        small = np.flatnonzero(states < _U32(_ALL))
        if len(small):
            new = self.words[self.at : self.at + len(small)]
            if len(new) < len(small):
                raise CorruptBlock("the block's words end early")
            self.at += len(small)
            states[small] = states[small] << _16 | new


def decode(block: bytes) -> np.ndarray:
    """The ids (uint32) of one block."""
    if len(block) < HEAD.size:
        raise CorruptBlock("the block has no whole head")
    magic, vocab, n, lanes, size, crc, ids_crc = HEAD.unpack_from(block)
    payload = block[HEAD.size : HEAD.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc:
        raise CorruptBlock("the block's checksum does not fit")
    behind = 4 + int.from_bytes(payload[:4], "little")
    table = zlib.decompress(payload[4:behind])
    many = int.from_bytes(table[:4], "little")
    used = np.cumsum(np.frombuffer(table, "<u4", many, 4), dtype=np.uint32)
    f = _Frequencies(np.frombuffer(table, "<u2", many, 4 + 4 * many).astype(np.int64))
    states = np.frombuffer(payload, "<u4", lanes, behind).astype(_U32)
    words = _Words(np.frombuffer(payload, "<u2", offset=behind + 4 * lanes).astype(_U32))
    model = _Model(f, lanes)
    steps = -(-n // lanes)
    out = np.zeros((steps, lanes), f.kind)
    for t in range(steps):
        cand, p = model.predict()
        slot = states & _LOW12
        hit = slot < p
        start, size = _part(p, hit)
        slot -= start
        states >>= _12
        states *= size
        states += slot
        words.fill(states)
        miss = np.flatnonzero(~hit)
        s = cand
        if len(miss):
            s[miss] = _decoded(states, miss, f, words)
        out[t] = s
        model.update(s, hit)
    ids = used.take(_turned(out).ravel()[:n]).astype("<u4", copy=False) if n else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise CorruptBlock("the ids' checksum does not fit")
    return ids


def _decoded(states: np.ndarray, miss: np.ndarray, f: _Frequencies, words: _Words) -> np.ndarray:
    """The symbols of the lanes ``miss``."""
    x = states[miss]
    slot = x & _LOW16
    s = _at(f.symbol, slot)
    part = _at(f.part, s)
    x >>= _16
    x *= part & _LOW16
    x += slot
    x -= part >> _16
    words.fill(x)
    if len(f.rare):
        rare = np.flatnonzero(s == f.n)
        if len(rare):
            y, place = x[rare], np.zeros(len(rare), np.int64)
            for low, bits in reversed(f.digits):
                place |= (y & _U32((1 << bits) - 1)).astype(np.int64) << low
                y >>= _U32(bits)
                words.fill(y)
            x[rare] = y
            s[rare] = f.rare.take(place)
    states[miss] = x
    return s
