"""A fixed-length bit set on the driver, as one Python integer."""

from __future__ import annotations

from collections.abc import Iterator


class BitSet:
    def __init__(self, length: int, bits: int = 0):
        self.length, self.bits = length, bits & ((1 << length) - 1)

    @classmethod
    def of(cls, length: int, positions) -> BitSet:
        return cls(length, sum(1 << p for p in set(positions)))

    @classmethod
    def from_words(cls, length: int, words: list[int]) -> BitSet:
        """From 64-bit words, the least first."""
        return cls(length, sum(w << (64 * k) for k, w in enumerate(words)))

    def words(self) -> list[int]:
        return [self.bits >> (64 * k) & (2**64 - 1) for k in range(-(-self.length // 64))]

    def __len__(self) -> int:
        return self.length

    def __eq__(self, other: object) -> bool:
        return isinstance(other, BitSet) and (self.length, self.bits) == (other.length, other.bits)

    def __hash__(self) -> int:
        return hash((self.length, self.bits))

    def is_empty(self) -> bool:
        return self.length == 0

    def ensure_capacity(self, length: int) -> None:
        self.length = max(self.length, length)

    def _known(self, p: int) -> None:
        if not 0 <= p < self.length:
            raise IndexError(f"bit {p} of {self.length}")

    def set(self, p: int) -> None:
        self._known(p)
        self.bits |= 1 << p

    def clear(self, p: int) -> None:
        self._known(p)
        self.bits &= ~(1 << p)

    def get(self, p: int) -> bool:
        return 0 <= p < self.length and bool(self.bits >> p & 1)

    def __and__(self, other: BitSet) -> BitSet:
        return BitSet(min(self.length, other.length), self.bits & other.bits)

    def __or__(self, other: BitSet) -> BitSet:
        return BitSet(max(self.length, other.length), self.bits | other.bits)

    def __invert__(self) -> BitSet:
        return BitSet(self.length, ~self.bits)

    def count(self) -> int:
        return self.bits.bit_count()

    def __iter__(self) -> Iterator[int]:
        bits = self.bits
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low
