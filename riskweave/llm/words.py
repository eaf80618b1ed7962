"""Words of many texts at once, as numpy arrays.

A batch of texts is cut into chunks of about a megabyte (a longer text makes a chunk of its own), so that
memory is bounded by the chunk and the longest text, whatever the batch holds. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D; UTF-8 never has those bytes inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0xD1342543DE82EF95)  # odd, 5 modulo 8
_TABLE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; kept for the worker's life."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 4096)
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        _powers[:] = [
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64))))
            for b in (BASE, inverse)
        ]
    return _powers[0], _powers[1]


class Chunk:
    """Some whole texts: bytes, the start and end of each word, and where each text's words begin."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.n = first, len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.n) + 1
        self.ends = np.cumsum(sizes)  # of the texts, each with one line break after it
        self.begins = self.ends - sizes
        space = SPACE[self.buf]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.starts = np.flatnonzero(~space & before)
        self.stops = np.flatnonzero(space & ~before)
        self.word_from = np.searchsorted(self.starts, self.begins)
        self.word_to = np.searchsorted(self.starts, self.ends)
        self.counts = self.word_to - self.word_from
        self.text_of = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit name for each word, the same for equal words everywhere."""
        up, down = powers(len(self.buf) + 1)
        sums = np.empty(len(self.buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[_LOWER[self.buf] if lower else self.buf] * up[: len(self.buf)], out=sums[1:])
        return mix((sums[self.stops] - sums[self.starts]) * down[self.starts])


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(texts: list[str | None]) -> Iterator[Chunk]:
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield Chunk(first, held)
            held, size, first = [], 0, i
        held.append(data)
        size += len(data) + 1
    if held:
        yield Chunk(first, held)


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """A name for each run of n neighbouring words (position by position, over text ends too)."""
    if len(names) < n:
        return np.zeros(0, dtype=np.uint64)
    out = names[: len(names) - n + 1].copy()
    for k in range(1, n):
        out *= BASE
        out += names[k : len(names) - n + 1 + k]
    return mix(out)


def first_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort by key, then value: order, where each key begins, the group of each sorted row, each group's least value."""
    order = np.lexsort((values, keys))
    sorted_keys = keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    begins = np.flatnonzero(new)
    return order, begins, np.cumsum(new) - 1, values[order[begins]]


class Meetings:
    """Rows in order of key and document, a batch at a time: which of them meet another document at their key.

    A key is one or several columns. Only the first document of the last key is held from batch to batch, so memory
    doesn't grow with a key's rows.
    """

    def __init__(self) -> None:
        self.key, self.doc, self.row, self.met = None, None, None, False

    def feed(self, keys: list[np.ndarray], docs: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each row: is its document greater than the key's first; does the key have several documents so far; and,
        apart, the row (keys, doc, values) of an earlier batch that has just met its first other document."""
        n = len(docs)
        owed = [x[:0] for x in (*keys, docs, *values)]
        if not n:
            return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool), owed
        first = starts(keys)
        goes_on = self.key is not None and all(k[0] == x for k, x in zip(keys, self.key, strict=True))
        begins = np.flatnonzero(first)
        lead = docs[begins]
        if goes_on:
            lead[0] = self.doc
        run = np.cumsum(first) - 1
        later = docs > lead[run]
        several = np.logical_or.reduceat(later, begins)
        if goes_on:
            if several[0] and not self.met:
                owed = self.row
            several[0] |= self.met
        if not goes_on or len(begins) > 1:
            at = begins[-1]
            self.row = [x[at : at + 1].copy() for x in (*keys, docs, *values)]
        self.key, self.doc, self.met = [k[-1] for k in keys], lead[-1], bool(several[-1])
        return later, several[run], owed


def starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
    for x in columns[1:]:
        new[1:] |= x[1:] != x[:-1]
    return new
