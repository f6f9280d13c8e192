"""Hashes of words and characters of many texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text that are hashed at once.
SLICE = 1 << 20
#: Words longer than this are hashed by BLAKE2 wherever they stand.
LONG_WORD = 4096
#: Places in a word that have a table of random numbers each.
PLACES = 64
_P = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_tables: list[np.ndarray] = []
_places: list[np.ndarray] = []
#: Classes of bytes for shapes: white space 0, lower case and bytes of other letters 1, upper case 2, digits 3, any other its own.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[_SPACE] = 0
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91], _CLASS[48:58] = 2, 3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (SplitMix64) of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    """Byte values, powers of the base and powers of its inverse."""
    if not _tables:
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        values[_SPACE] = 0
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(SLICE + 1, base, np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
        _tables.insert(0, values)
    return _tables


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least `size` powers of the base and of its inverse."""
    _, up, down = _powers()
    if size <= len(up):
        return up, down
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64)))


def _shapes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each word's changes of class, from byte to byte: alike for words that look alike."""
    kind = _CLASS[raw]
    change = np.concatenate([[0], kind[:-1]]) * 256 + kind
    change[kind == 0] = 0
    change[1:][kind[1:] == kind[:-1]] = 0
    return mix(np.add.reduceat(mix(change.astype(np.uint64)), starts))


def _slice_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of at most SLICE bytes."""
    values, up, down = _powers()
    raw = np.frombuffer(data, np.uint8)
    black = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(black, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64)
    sums = np.add.reduceat(values[raw] * up[: len(raw)], starts)
    hashes = mix(sums * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[k] = _long(data[starts[k] : ends[k]])
    return starts, hashes


def _long(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _text_hashes(data: bytes, shapes: bool = False) -> np.ndarray:
    """Hashes (or shapes) of the words of one text of any length: cut at white space, and a word that fills a slice by itself."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # one word longer than a slice, which starts here
                word = data[at:].split(None, 1)[0]
                out.append(np.array([1 if shapes else _long(word)], np.uint64))
                at += len(word)
                continue
            end = cut + 1
        starts, hashes = _slice_hashes(data[at:end])
        out.append(_shapes(np.frombuffer(data[at:end], np.uint8), starts) if shapes and len(starts) else hashes)
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes], shapes: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes of all words in order, bounds): words of texts[i] are hashes[bounds[i]:bounds[i + 1]].

    Words are what stands between ASCII white space. Equal words have equal hashes in any
    run. With `shapes`, a number for each word's shape stands between the two.
    """
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    looks: list[np.ndarray] = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts) + 1, np.int64)
    k = 0
    while k < len(texts):
        if len(texts[k]) >= SLICE:
            hashes.append(_text_hashes(texts[k]))
            if shapes:
                looks.append(_text_hashes(texts[k], True))
            counts[k + 1] = len(hashes[-1])
            k += 1
            continue
        size, j = 0, k
        while j < len(texts) and size + len(texts[j]) + 1 <= SLICE:
            size += len(texts[j]) + 1
            j += 1
        joined = b" ".join(texts[k:j])
        starts, own = _slice_hashes(joined)
        at = np.cumsum([0] + [len(x) + 1 for x in texts[k:j]])
        counts[k + 1 : j + 1] = np.diff(np.searchsorted(starts, at))
        hashes.append(own)
        if shapes and len(starts):
            looks.append(_shapes(np.frombuffer(joined, np.uint8), starts))
        k = j
    bounds = np.cumsum(counts)
    return (np.concatenate(hashes), np.concatenate(looks), bounds) if shapes else (np.concatenate(hashes), bounds)


def _random_tables() -> tuple[np.ndarray, np.ndarray]:
    """Two tables of a random number for each byte at each place in a word."""
    if not _places:
        for seed in (1, 2):
            _places.append(mix(mix(np.arange(PLACES * 256, dtype=np.uint64) + np.uint64(seed << 32)) ^ np.uint64(0xA0761D6478BD642F)))
    return _places[0], _places[1]


def paired_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hashes, second hashes, bounds) of all words in order, where words of texts[i] are [bounds[i]:bounds[i + 1]].

    Each hash is tabulated: the sum of a random number for each byte at its place, so no rule
    in the words makes them collide, and the two are independent. Words above PLACES bytes get the halves of their BLAKE2 digest.
    """
    one: list[np.ndarray] = [np.zeros(0, np.uint64)]
    two: list[np.ndarray] = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts) + 1, np.int64)
    k = 0
    while k < len(texts):
        size, j = 0, k
        while j < len(texts) and (j == k or size + len(texts[j]) < SLICE):
            size += len(texts[j]) + 1
            j += 1
        data = b" ".join(texts[k:j])
        raw = np.frombuffer(data, np.uint8)
        black = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(black, prepend=False, append=False))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        counts[k + 1 : j + 1] = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts[k:j]])))
        if len(starts):
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
            cell = np.minimum(place, PLACES - 1) * 256 + raw[black]
            for table, out in zip(_random_tables(), (one, two), strict=True):
                out.append(mix(np.add.reduceat(table[cell], first) + sizes.astype(np.uint64)))
            for w in np.flatnonzero(sizes > PLACES):
                digest = hashlib.blake2b(data[starts[w] : starts[w] + sizes[w]], digest_size=16).digest()
                one[-1][w], two[-1][w] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
        k = j
    return np.concatenate(one), np.concatenate(two), np.cumsum(counts)
