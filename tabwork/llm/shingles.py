"""Five-word shingles of whole texts as 64-bit hashes, worked out for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2 ** 63, size=256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and its inverse mod 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2 ** 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 19), b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order (A-Z in lower case), and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    up, down = _power(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:len(data)], dtype=np.uint64)])
    word = ~_BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; one for all words where there are fewer; none without words."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    step = np.uint64(0x2545F4914F6CDD1D)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * step + words[k:len(words) - width + 1 + k] if len(rolled) else rolled
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at:at + n - width + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for w in words[at:at + n]:
                whole = whole * step + w
            out.append(mixed(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def in_chunks(batch, most: int = 1 << 18, rows: int = 512):
    """(ids, texts) of an Arrow batch of two columns, in runs of about `most` characters; only `rows` texts are Python strings at a time."""
    for begin in range(0, batch.num_rows, rows):
        part = batch.slice(begin, rows)
        ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most or i + 1 == len(texts):
                yield ids[at:i + 1], texts[at:i + 1]
                at, size = i + 1, 0
