"""Minimal perfect hashes of byte strings, built and asked many keys at a time.

Keys are places in one buffer: an offset and a length each. A key's 64-bit hash takes its bytes
eight at a time. A table's level is a bit array twice as long as its keys; keys that are alone at
their bit stay, all others go on to the next level with another multiplier. The number of set bits
before a key's bit is its number. Numbers are then mapped to the order of the keys as bytes.
Keys are stored, and a key that is asked for is compared with the stored one byte for byte, so
others are told apart for certain. Two keys of equal hash make ``build`` take another seed.
"""

from __future__ import annotations

import pickle

import numpy as np

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], _U)


def _times(n: int) -> np.uint64:
    return _U(n * int(_A) & (1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _B
    x = (x ^ (x >> _U(29))) * _A
    return x ^ (x >> _U(32))


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``buffer`` ends in eight bytes more."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))


def padded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw + b"\0" * 8, np.uint8)


def hashes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each key. Passes over the keys go on while there are longer ones."""
    words = _words(buffer)
    out = _mix(lengths.astype(_U) + _times(seed + 1))
    left, at = None, 0
    while True:
        some = slice(None) if left is None else left
        here = lengths[some] - at
        piece = words[starts[some] + at] & _MASKS[np.minimum(here, 8)]
        out[some] = _mix(out[some] ^ piece) + _A
        at += 8
        left = np.flatnonzero(lengths > at) if left is None else left[lengths[left] > at]
        if not len(left):
            return out


def equal(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
          others: np.ndarray, other_starts: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Which keys equal their counterpart byte for byte."""
    a, b = _words(buffer), _words(others)
    same = lengths == other_lengths
    left, at = np.flatnonzero(same), 0
    while len(left):
        mask = _MASKS[np.minimum(lengths[left] - at, 8)]
        differ = (a[starts[left] + at] ^ b[other_starts[left] + at]) & mask != 0
        same[left[differ]] = False
        at += 8
        left = left[~differ & (lengths[left] > at)]
    return same


class PerfectHash:
    """A set of keys numbered 0, 1, ... in the order of their bytes."""

    LEVELS = 60

    def __init__(self, keys: list[bytes]):
        """``keys`` are distinct."""
        keys = sorted(keys)
        self._store(b"".join(keys), np.array([len(k) for k in keys], np.int64))
        self.seed = 0
        while not self._build():
            self.seed += 1

    def _store(self, raw: bytes, lengths: np.ndarray) -> None:
        self.n, self.buffer, self.lengths = len(lengths), padded(raw), lengths
        self.starts = np.cumsum(np.concatenate([[0], lengths])).astype(np.int64)[:-1]

    def to_bytes(self) -> bytes:
        levels = [(np.packbits(alone), int(counts[0]) if len(counts) else 0, size) for alone, counts, size in self.levels]
        return pickle.dumps((self.buffer[:-8].tobytes(), self.lengths.astype(np.uint32), self.order, self.seed, levels), 5)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        made = cls.__new__(cls)
        keys, lengths, made.order, made.seed, levels = pickle.loads(raw)
        made._store(keys, lengths.astype(np.int64))
        made.levels = []
        for bits, before, size in levels:
            alone = np.unpackbits(bits, count=size).astype(bool)
            made.levels.append((alone, (np.cumsum(np.concatenate([[0], alone[:-1]])) + before).astype(np.int32), size))
        return made

    def _build(self) -> bool:
        h = hashes(self.buffer, self.starts, self.lengths, self.seed) if self.n else np.zeros(0, _U)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rank = np.empty(self.n, np.int64)
        left, before = np.arange(self.n), 0
        while len(left):
            if len(self.levels) == self.LEVELS:
                return False
            size = max(64, 2 * len(left))
            at = self._place(h[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            counts = np.cumsum(np.concatenate([[0], alone[:-1]])) + before
            self.levels.append((alone, counts.astype(np.int32), size))
            stay = alone[at]
            rank[left[stay]] = counts[at[stay]]
            before += int(alone.sum())
            left = left[~stay]
        self.order = np.empty(self.n, np.int32)  # from number to place among the sorted keys
        self.order[rank] = np.arange(self.n)
        return True

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(h + _times(level)) % _U(size)).astype(np.int64)

    def find(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashed: np.ndarray | None = None) -> np.ndarray:
        """The number of each key, -1 for those that are not in the set. ``hashed`` are hashes with seed 0."""
        out = np.full(len(starts), -1, np.int64)
        if not self.n or not len(starts):
            return out
        h = hashed if hashed is not None and not self.seed else hashes(buffer, starts, lengths, self.seed)
        left = np.arange(len(starts))
        for level, (alone, counts, size) in enumerate(self.levels):
            at = self._place(h[left], level, size)
            hit = alone[at]
            out[left[hit]] = self.order[counts[at[hit]]]
            left = left[~hit]
            if not len(left):
                break
        asked = np.flatnonzero(out >= 0)
        of = out[asked]
        same = equal(buffer, starts[asked], lengths[asked], self.buffer, self.starts[of], self.lengths[of])
        out[asked[~same]] = -1
        return out

    def key(self, number: int) -> bytes:
        start = int(self.starts[number])
        return self.buffer[start : start + int(self.lengths[number])].tobytes()
