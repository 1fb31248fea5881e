"""Random changes of single characters, for all texts of a piece at once.

The number drawn for a character is ``pmod(xxhash64(key, position, seed), 100)``. Spark takes one
interpreted step for each character and change of an array of them; here the characters of many
texts are one array of code points, and a change goes through it in numpy. Position and key are
hashed once for all changes. A piece is bounded in texts and bytes (one text at least), a block of
draws in characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import fixed
from .pieces import ROWS

#: From code points and their hashes: the changed code points, and after which of the old ones others were put in.
Change = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

BYTES, BLOCK = 1 << 21, 1 << 15
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_NONE = np.zeros(0, np.int64)
_CASED = 1 << 17  # no letter from here on has two cases
#: Pairs of Unicode 16, which Spark's ``lower`` and ``upper`` know and Python 3.13 does not.
_LOWER = {"\ua7dc": "\u019b", "\ua7cb": "\u0264", "\u1c89": "\u1c8a", "\ua7cc": "\ua7cd", "\ua7da": "\ua7db"} | {chr(c): chr(c + 32) for c in range(0x10D50, 0x10D66)}
_UPPER = {low: up for up, low in _LOWER.items()}


def _hashed(h: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Spark's ``xxhash64`` of a 32-bit number, going on from hashes ``h``."""
    h = (h + (_P5 + np.uint64(4))) ^ (np.asarray(number).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2
    h += _P3
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _draw(h: np.ndarray, seed: int) -> np.ndarray:
    """A repeatable number in 0..99 for each hash of row and position."""
    x = _hashed(h, seed).view(np.int64)
    return x - x // 100 * 100


def swapped(percent: int, maps: tuple[str, str] = fixed.HOMOGLYPH_NINE, seed: int = 1) -> Change:
    """Swap mapped letters with a probability."""
    to = np.zeros(max(map(ord, maps[0])) + 2, np.uint32)
    to[[*map(ord, maps[0])]] = [*map(ord, maps[1])]

    def change(codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = to[np.minimum(codes, len(to) - 1)]
        at = np.flatnonzero(new)
        at = at[_draw(h[at], seed) < percent]
        out = codes.copy()
        out[at] = new[at]
        return out, _NONE

    return change


@cache
def _cases() -> tuple[np.ndarray, np.ndarray]:
    """Which code points a case changes; lower and upper forms of up to three code points, by place in the form."""
    forms = np.zeros((3, 2, _CASED), np.uint32)
    forms[0] = np.arange(_CASED)
    for c in map(chr, range(_CASED)):
        for k, form in enumerate((_LOWER.get(c, c.lower()), _UPPER.get(c, c.upper()))):
            if form != c:
                forms[: len(form), k, ord(c)] = [*map(ord, form)]
    return (forms[0] != np.arange(_CASED)).any(0) | forms[1].any(0), forms


def cased(seed: int = 2) -> Change:
    """Draw a case for each letter; a letter may become two or three."""

    def change(codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        has, forms = _cases()
        at = np.flatnonzero(has[np.minimum(codes, _CASED - 1)])
        which, c, out = (_draw(h[at], seed) < 50).astype(np.int8), codes[at], codes.copy()
        out[at] = forms[0, which, c]
        more = [(at[m], x[m]) for x in (f[which, c] for f in forms[1:]) if (m := x > 0).any()]
        if not more:
            return out, _NONE
        put = np.concatenate([a for a, _ in more])
        return np.insert(out, put + 1, np.concatenate([x for _, x in more])), np.sort(put)

    return change


def inserted(percent: int = 30, seed: int = 3, chars: str = fixed.ZERO_WIDTH) -> Change:
    """Put one of some characters after a character with a probability."""
    which = np.array([*map(ord, chars)], np.uint32)

    def change(codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(_draw(h, seed) < percent)
        return np.insert(codes, at + 1, which[_draw(h[at], seed + 1) % len(which)]), at

    return change


def changed(texts: list[bytes | None], keys: np.ndarray, changes: list[Change]) -> list[pa.Array]:
    """The texts after each of the changes; ``keys`` are the hashes of their rows. Bytes that are not UTF-8 stay as they are."""
    plain = ["" if t is None else t.decode("utf-8", "surrogateescape") for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    done = [([codes[:0]], [_NONE]) for _ in changes]
    for lo in range(0, len(codes), BLOCK):
        hi = min(lo + BLOCK, len(codes))
        rows = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left"))
        n = np.minimum(ends[rows], hi) - np.maximum(starts[rows], lo)
        h = _hashed(np.repeat(keys[rows], n), np.arange(lo, hi) - np.repeat(starts[rows], n))
        for change, (outs, puts) in zip(changes, done, strict=True):
            out, put = change(codes[lo:hi], h)
            outs.append(out)
            puts.append(put + lo)
    arrays = []
    for outs, puts in done:
        whole = np.concatenate(outs).tobytes().decode("utf-32-le", "surrogatepass")
        stops = (ends + np.searchsorted(np.concatenate(puts), ends)).tolist()
        each = (whole[a:b].encode("utf-8", "surrogateescape") for a, b in zip([0, *stops], stops))
        arrays.append(pa.array([None if t is None else x for t, x in zip(texts, each, strict=True)], pa.binary()).view(pa.string()))
    return arrays


def cuts(sizes: np.ndarray, rows: int = ROWS, size: int = BYTES) -> Iterator[slice]:
    """Runs of at most so many texts and bytes, or of one text."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        fit = int(np.searchsorted(total, size + (total[at - 1] if at else 0), "right"))
        to = min(max(fit, at + 1), at + rows)
        yield slice(at, to)
        at = to


def randomly(**changes: Change) -> Callable[[Column, Column], Column]:
    """A column function of text and key: a struct with the text after each change; draws are seeded by key and position.

    Null text gives null fields, an empty one stays empty.
    """
    names, each = list(changes), list(changes.values())

    @F.arrow_udf(StructType([StructField(n, StringType()) for n in names]))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            hashes = keys.to_numpy(zero_copy_only=False).view(np.uint64)
            raw = texts.cast(pa.binary())
            for cut in cuts(pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)):
                yield pa.StructArray.from_arrays(changed(raw[cut].to_pylist(), hashes[cut], each), names=names)

    return lambda text, key: run(text, F.xxhash64(key))
