"""Elias-Fano sequences and an n-gram trie of flat levels.

All levels are plain buffers, so that a saved trie can be mapped from a file and queried in place. All lookups work on
whole arrays of queries at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np

#: For each byte value and k, the place of its k-th set bit; 8 where there is none.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1).astype(np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)
for _k in range(8):
    _rows, _at = np.nonzero((np.cumsum(_BITS, 1) == _k + 1) & (_BITS == 1))
    _SELECT[_rows, _k] = _at


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers.

    Each number is split: `low` keeps its last bits, packed; `high` is a bit string in which the i-th number with first
    bits h sets bit h + i. ones_before: set bits before each 64-bit word of it.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones_before: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones_before = n, bits, low, high, ones_before
        self.zeros_before = np.arange(len(ones_before), dtype=np.int64) * 64 - ones_before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(1, n)).bit_length() - 1))
        first = (values >> np.uint64(bits)).astype(np.int64)
        words = (int(first[-1]) + n) // 64 + 2 if n else 2
        marks = np.zeros(words * 64, np.uint8)
        marks[first + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[high].reshape(-1, 8).sum(1, dtype=np.int64))])
        low = np.zeros((n * bits + 7) // 8 + 9, np.uint8)
        for at in range(0, n if bits else 0, 1 << 16):  # as many numbers as give whole bytes
            last = values[at : at + (1 << 16)] & np.uint64((1 << bits) - 1)
            shown = np.unpackbits(last.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
            packed = np.packbits(shown.ravel(), bitorder="little")
            low[at * bits // 8 : at * bits // 8 + len(packed)] = packed
        return cls(n, bits, low, high, ones.astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        b, shift = at >> 3, (at & 7).astype(np.uint64)
        got = np.zeros(len(i), np.uint64)
        for k in range((self.bits + 14) // 8):
            byte = self.low[b + k].astype(np.uint64)
            got |= (byte >> shift) if k == 0 else byte << (np.uint64(8 * k) - shift)
        return got & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit."""
        before = self.ones_before if ones else self.zeros_before
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        bits = self.high.view("<u8")[np.minimum(word, len(self.high) // 8 - 1)]
        if not ones:
            bits = ~bits
        at = word * 64
        for width in (32, 16, 8):  # the half that holds the bit
            here = np.bitwise_count(bits & np.uint64((1 << width) - 1))
            beyond = left >= here
            left = left - np.where(beyond, here, 0)
            step = beyond * np.uint8(width)
            bits, at = bits >> step.astype(np.uint64), at + step
        return at + _SELECT[(bits & np.uint64(255)).astype(np.uint8), np.minimum(left, 7)]

    def access(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number that is not less than each x; n where there is none.

        The clear bits of the high part bound the numbers with the same first bits; a binary search over their last
        bits finds the place.
        """
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        most = int(self.zeros_before[-1])
        inside = h < most
        hh = np.where(inside, h, 0)
        lo = np.where(hh > 0, self._select(np.maximum(hh - 1, 0), False) - hh + 1, 0)
        hi = self._select(hh, False) - hh
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        want = x & np.uint64((1 << self.bits) - 1)
        todo = np.nonzero(inside & (lo < hi))[0]
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return np.where(inside, lo, self.n)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1."""
        at = self.successor(x)
        ok = at < self.n
        out = np.full(len(x), -1, np.int64)
        got = at[ok]
        out[ok] = np.where(self.access(got) == x[ok].astype(np.uint64), got, -1)
        return out

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones_before}

    @classmethod
    def from_parts(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = parts[f"{name}.head"].tolist()
        return cls(n, bits, parts[f"{name}.low"], parts[f"{name}.high"], parts[f"{name}.ones"])


#: Probabilities are kept as steps of -log10, up to 255 steps.
STEP = 1 / 32


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities over 0 and up to 1; 255 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(p) / STEP), 255).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 255, 0.0, 10.0 ** (-STEP * codes.astype(np.float64)))


class Trie:
    """Contexts, and for each its successors with a discounted probability.

    contexts: context hashes. begins: where the successors of each context begin. words: hashes of the words that
    succeed any. successors: context place * number of words + place of the word, so that the numbers of one context
    are relative to it and the whole is monotone. shares, rests: codes of the discounted probability of each successor
    and of what the context leaves to the shorter one.
    """

    LEVELS = ("contexts", "begins", "words", "successors")

    def __init__(self, levels: dict[str, EliasFano], shares: np.ndarray, rests: np.ndarray):
        self.levels, self.shares, self.rests = levels, shares, rests

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, n: np.ndarray, discount: float) -> Trie:
        """From distinct (context, word) with counts, ordered by both."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        words = np.unique(word)
        total = np.add.reduceat(n, first).astype(np.float64) if len(first) else np.zeros(0)
        kinds = np.diff(np.append(first, len(context)))
        of = np.repeat(np.arange(len(first)), kinds)
        place = of.astype(np.uint64) * np.uint64(max(1, len(words))) + np.searchsorted(words, word).astype(np.uint64)
        levels = {"contexts": context[first], "begins": np.append(first, len(context)), "words": words, "successors": place}
        return cls({k: EliasFano.of(v) for k, v in levels.items()}, quantise((n - discount) / total[of]), quantise(discount * kinds / np.maximum(total, 1)))

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the share of each word after its context (255: unseen) and of the context's rest (0: unseen).

        Queries are ordered by context, so that each context is looked up once; so is each word.
        """
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        c = np.repeat(self.levels["contexts"].find(context[first]), np.diff(np.append(first, len(context))))
        words, of = np.unique(word, return_inverse=True)
        w = self.levels["words"].find(words)[of]
        shares, rests = np.full(len(c), 255, np.uint8), np.zeros(len(c), np.uint8)
        seen = c >= 0
        rests[seen] = self.rests[c[seen]]
        both = np.nonzero(seen & (w >= 0))[0]
        at = self.levels["successors"].find(c[both].astype(np.uint64) * np.uint64(max(1, self.levels["words"].n)) + w[both].astype(np.uint64))
        shares[both[at >= 0]] = self.shares[at[at >= 0]]
        return shares, rests

    def save(self, out: BinaryIO) -> None:
        """Write all levels, one after the other, each at a multiple of 8 bytes from the beginning."""
        parts = {k: v for name in self.LEVELS for k, v in self.levels[name].parts(name).items()} | {"shares": self.shares, "rests": self.rests}
        head = "\n".join(f"{k} {v.dtype.str} {len(v)}" for k, v in parts.items()).encode()
        at = out.write(len(head).to_bytes(8, "little") + head)
        for v in parts.values():
            at += out.write(b"\0" * (-at % 8))
            at += out.write(memoryview(np.ascontiguousarray(v)).cast("B")) if len(v) else 0

    @classmethod
    def load(cls, buffer) -> Trie:
        """From what save() wrote, as np.memmap or as bytes: the levels stay where they are."""
        raw = np.frombuffer(buffer, np.uint8) if isinstance(buffer, (bytes, memoryview)) else np.asarray(buffer)
        size = int.from_bytes(raw[:8].tobytes(), "little")
        at, parts = 8 + size, {}
        for line in raw[8 : 8 + size].tobytes().decode().split("\n"):
            name, kind, n = line.split(" ")
            at += -at % 8
            end = at + int(n) * np.dtype(kind).itemsize
            parts[name] = raw[at:end].view(kind)
            at = end
        return cls({name: EliasFano.from_parts(parts, name) for name in cls.LEVELS}, parts["shares"], parts["rests"])


@contextmanager
def mapped(trie: Trie) -> Iterator[Trie]:
    """trie as it is queried: its levels are written to a file in memory and mapped from there, and the arrays that it was
    built from can go. The file has no place in any folder and ends with the task that made it.
    """
    with open(os.memfd_create("trie"), "w+b") as file:
        trie.save(file)
        file.flush()
        del trie
        yield Trie.load(np.memmap(file, np.uint8, "r"))
