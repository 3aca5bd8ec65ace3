"""Random access to bytes in memory or in an open file."""

from __future__ import annotations

import struct


class Source:
    """Reads at absolute places; never fails beyond the end, it returns less."""

    def __init__(self, data: bytes | None = None, file=None, size: int | None = None):
        self.data, self.file = data, file
        self.size = len(data) if data is not None else size

    @staticmethod
    def of(x: Source | bytes) -> Source:
        return x if isinstance(x, Source) else Source(bytes(x))

    def at(self, place: int, n: int) -> bytes:
        if place < 0 or n <= 0:
            return b""
        if self.data is not None:
            return self.data[place : place + n]
        self.file.seek(place)
        return self.file.read(n)

    def num(self, place: int, form: str) -> int | None:
        """A number by its struct code, such as '<I'; None where bytes are missing."""
        raw = self.at(place, struct.calcsize(form))
        return struct.unpack(form, raw)[0] if len(raw) == struct.calcsize(form) else None

    def find(self, what: bytes, start: int, stop: int, step: int = 256 << 10) -> int:
        """First place of `what` that lies in start..stop as a whole; -1 if none. Pieces overlap, so none is missed at a seam."""
        at = start
        while at < stop:
            piece = self.at(at, min(step + len(what) - 1, stop - at))
            found = piece.find(what)
            if found >= 0:
                return at + found
            if len(piece) < len(what):
                return -1
            at += step
        return -1


class Window:
    """Up to n bytes of a source from a place on, for walks in small steps: they are read in blocks, each only when the walk comes there."""

    def __init__(self, src: Source, place: int, n: int, block: int = 16 << 10):
        self.src, self.place, self.n, self.block = src, place, n, block
        self.base, self.held = 0, b""

    def at(self, i: int, n: int) -> bytes:
        """n bytes from place i of the window on, fewer at its end."""
        n = min(n, self.n - i)
        if n <= 0:
            return b""
        if not self.base <= i <= i + n <= self.base + len(self.held):
            self.base, self.held = i, self.src.at(self.place + i, min(max(n, self.block), self.n - i))
        return self.held[i - self.base : i - self.base + n]

    def byte(self, i: int) -> int | None:
        """The byte at place i; None beyond the end."""
        if 0 <= i - self.base < len(self.held):
            return self.held[i - self.base]
        found = self.at(i, 1)
        return found[0] if found else None
