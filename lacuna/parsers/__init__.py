"""Pure functions from bytes to extents, sizes and tags. A registry names the extent parsers; more can be added."""

from __future__ import annotations

from collections.abc import Callable

from .source import Source

#: strategy -> (source, start, most bytes) -> end, or None if there is no such file.
EXTENTS: dict[str, Callable[[Source, int, int], int | None]] = {}


def extent(strategy: str):
    """Registers a parser under a strategy's name."""

    def add(f):
        EXTENTS[strategy] = f
        return f

    return add


def find_end(strategy: str, source: Source | bytes, start: int, most: int) -> int | None:
    """The end of the file that begins at start, by the named parser."""
    from . import images, videos  # noqa: F401  (they register themselves)

    return EXTENTS[strategy](Source.of(source), start, most)
