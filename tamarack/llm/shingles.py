"""Five-word shingle sets of whole texts, hashed in bulk with numpy.

A text is lower-cased on A-Z only and cut into words ``[^\\x20\\x09-\\x0D]+``. Its set holds
the distinct runs of five words; with one to four words, the whole sequence is the only
member; without words the set is empty. Members are 64-bit hashes: a word's bytes give a
word hash (a polynomial one up to ``LONG`` bytes, where its known collisions of long
patterned strings cannot arise, else BLAKE2), and a member mixes the hashes of its words,
weighed by place and count.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WORDS = 5
LONG = 64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the output."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE = mix64(np.arange(256, dtype=np.uint64), 7)
_PLACE = mix64(np.arange(64, dtype=np.uint64), 8) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer inputs come."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 19)
            self.up, self.down = _powers(_BASE, self.n), _powers(_BASE_INV, self.n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct member hashes of each text (null and empty texts: none)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):  # about 500 kB at a time, or one longer text
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < 500_000):
            size += len(raw[end]) + 1
            end += 1
        out += _sets(raw[at:end], k)
        at = end
    return out


def _sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    doc_start = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=doc_start[1:])
    word = ~_WS[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(before & ~word)
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(raw)
    kept = word | before
    place = np.cumsum(kept, dtype=np.int64) - 1
    text = np.where(word, _LOWER[buf], 32).astype(np.uint8)[kept]
    up, down = _POWERS.get(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up, out=total[1:])
    first, last = place[starts], place[ends]  # a word is text[first:last]
    size = last - first
    word_hash = mix64((total[last] - total[first]) * down[first], 1) ^ size.astype(np.uint64)
    for w in np.flatnonzero(size > LONG).tolist():
        word_hash[w] = int.from_bytes(blake2b(text[first[w] : last[w]].tobytes(), digest_size=8).digest(), "little")
    runs = np.zeros(max(0, len(starts) - k + 1), np.uint64)
    for j in range(k):
        runs += word_hash[j : j + len(runs)] * _PLACE[j]
    runs = mix64(runs, k)
    bound = np.searchsorted(starts, doc_start)
    out = []
    for i in range(len(raw)):
        a, b = bound[i], bound[i + 1]
        if a == b:
            out.append(np.empty(0, np.uint64))
            continue
        members = runs[a : b - k + 1] if b - a >= k else mix64((word_hash[a:b] * _PLACE[: b - a]).sum(keepdims=True), int(b - a))
        out.append(np.unique(members))
    return out
