"""Vectorized word hashing: a batch of texts to 64-bit hashes of their words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REACH = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))


_BYTE = mix(np.arange(1, 257, dtype=U))
_POWER = mix(np.arange(1, _REACH + 1, dtype=U)) | U(1)


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) of runs of about ``limit`` bytes; a longer text is a run of its own."""
    run, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and one past the last, byte where each word starts, ends).

    Words are maximal runs of bytes other than the six ASCII white spaces;
    word i of text t is ``first[t] + i``. Byte places count from the start of
    the joined texts, which are parted by one byte.
    """
    joined = np.frombuffer(b" " + b" ".join(raws) + b" ", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([1] + [len(r) + 1 for r in raws])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=U), first, starts, ends
    sizes = ends - starts
    total = np.cumsum(sizes)
    within = np.arange(total[-1]) - np.repeat(total - sizes, sizes)
    letters = joined[~space]
    parts = _BYTE[letters] * _POWER[within & (_REACH - 1)] + (within >> 12).astype(U)
    summed = np.add.reduceat(parts, total - sizes)
    return mix(summed + sizes.astype(U)), first, starts, ends


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of k words; a shorter text with a word is one shingle."""
    n, n_texts = len(words), len(first) - 1
    text_of = np.repeat(np.arange(n_texts), np.diff(first))
    if not n:
        return np.zeros(0, dtype=U), text_of
    made = np.zeros(max(n - k + 1, 0), dtype=U)
    for j in range(k):
        made = mix(made + words[j : n - k + 1 + j]) if len(made) else made
    whole = text_of[: len(made)] == text_of[k - 1 :] if len(made) else np.zeros(0, dtype=bool)
    out, owner = made[whole], text_of[: len(made)][whole]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(short):
        extra = np.array([mix(np.bitwise_xor.reduce(seeded(words[first[t] : first[t + 1]], 0) * (np.arange(1, first[t + 1] - first[t] + 1, dtype=U) * U(2) + U(1))).reshape(1))[0] for t in short], dtype=U)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return out, owner


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text index) with their counts, by text, then hash."""
    if not len(hashes):
        return hashes, owner, np.zeros(0, dtype=np.int64)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    return h[new], o[new], np.diff(np.concatenate([new, [len(h)]]))


def slide(x: np.ndarray, width: int, reduce: np.ufunc) -> np.ndarray:
    """``reduce`` over x[i : i + width] for every full window, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = reduce(x[: len(x) - step], x[step:])
        have += step
    return x


def minimum_places(order: np.ndarray, text_of: np.ndarray, gap: int, size: int) -> np.ndarray:
    """Places whose ``order`` (over 0) is least in a run of ``gap`` places, where ``size`` words from each of the run lie in one text."""
    n = len(text_of) - (gap + size - 2)
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = slide(order, gap, np.minimum)[:n].copy()
    low[text_of[:n] != text_of[gap + size - 2 :]] = 0  # runs over two texts choose nothing
    padded = np.concatenate([np.zeros(gap - 1, dtype=U), low, np.zeros(gap - 1, dtype=U)])
    return np.flatnonzero(slide(padded, gap, np.maximum) == order[: n + gap - 1])
