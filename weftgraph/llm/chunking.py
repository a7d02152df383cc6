"""Content-defined chunks of texts by a gear rolling hash (problem 9).

A gear hash over the last 8 characters is rolled over a text. Coarse cuts are the places where it is least among 70
consecutive places, fine cuts where it is least among 12: both depend on nothing but the characters around them, so an
insertion moves no cut beyond its neighbourhood. A chunk runs from a coarse cut to the first fine cut at least 100
characters on. In any run of 200 characters one chunk lies wholly, cut alike wherever the run stands: its coarse cut is
among the run's first 77 characters, its fine cut before the 189th, and every place that decides them is in the run.

Texts are handled in tiles of bounded size whatever their length; tiles overlap by more than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from weftgraph.functions.shipping import by_value

GEAR, COARSE, FINE, LEAST, RUN = 8, 70, 12, 100, 200
TILE = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str) -> np.ndarray:
    if not _tables:
        codes = np.arange(0x110000, dtype=np.uint64)
        _tables["gear"] = _mixed(codes * np.uint64(_MULTIPLIER) + np.uint64(1))
        powers = np.full(TILE + 4 * RUN, _MULTIPLIER, dtype=np.uint64)
        powers[0] = 1
        _tables["power"] = np.multiply.accumulate(powers)
        powers = np.full(TILE + 4 * RUN, pow(_MULTIPLIER, -1, 1 << 64), dtype=np.uint64)
        powers[0] = 1
        _tables["inverse"] = np.multiply.accumulate(powers)
    return _tables[name]


def _wider(low: np.ndarray, size: int, window: int) -> np.ndarray:
    """Minima over ``window`` places from minima over ``size``."""
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    return low


def _places(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places that are least (the first of equals) in the windows that begin at ``starts``."""
    found = (low[starts] & np.uint64((1 << 21) - 1)).astype(np.int64)
    return found[np.flatnonzero(np.diff(found, prepend=-1))]  # they never fall


def _tile_chunks(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, digest) of the chunks of texts laid end to end; text i is codes[bounds[i]:bounds[i + 1]]."""
    n = len(codes)
    values = _table("gear")[codes]
    rolled, step = values, 1
    while step < GEAR:  # sums of 2, 4, 8 characters, each older one shifted further
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint64(step)
        rolled, step = wider, step * 2
    key = (rolled & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    sizes = np.diff(bounds)
    owner_end = np.repeat(bounds[1:], sizes)
    place = np.arange(n)
    sound = place - np.repeat(bounds[:-1], sizes) >= GEAR - 1  # the hash has no character of another text
    if n < COARSE:
        return place[:0], place[:0], values[:0]
    low = _wider(key, 1, FINE)
    room = owner_end - place
    fine = _places(low, np.flatnonzero(sound & (room >= FINE)))
    coarse = _places(_wider(low, FINE, COARSE), np.flatnonzero(sound & (room >= COARSE)))
    if not len(coarse):
        return coarse, coarse, coarse.astype(np.uint64)
    at = np.searchsorted(fine, coarse + LEAST)
    ends = np.where(at < len(fine), fine[np.minimum(at, len(fine) - 1)], n + 1)
    inside = ends <= owner_end[coarse]
    begin, end = coarse[inside], ends[inside]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _table("power")[:n], dtype=np.uint64)])
    digest = _mixed((sums[end] - sums[begin]) * _table("inverse")[begin] + (end - begin).astype(np.uint64))
    return begin, end, digest


def text_chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, begin, end, digest as a signed number) for bounded tiles of the texts."""
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        codes = np.concatenate([p[2] for p in parts])
        bounds = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
        begin, end, digest = _tile_chunks(codes, bounds)
        k = np.searchsorted(bounds, begin, side="right") - 1
        shift = np.array([p[1] for p in parts])[k] - bounds[:-1][k]
        return np.array([p[0] for p in parts])[k], begin + shift, end + shift, digest.view(np.int64)

    overlap = GEAR + COARSE + LEAST + 3 * FINE
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for a in range(0, max(1, len(codes) - overlap), TILE - overlap):
            part = codes[a : a + TILE]
            if size + len(part) > TILE and parts:
                yield flush()
                parts, size = [], 0
            parts.append((i, a, part))
            size += len(part)
    if parts:
        yield flush()


by_value(__name__)
