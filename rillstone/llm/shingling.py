"""Sets of word n-grams as hashes, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2**64; kept for the next batch."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True


def word_shingles(parts: list[str], owner: np.ndarray, n_owners: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `words` consecutive words per owner, and where each owner's begin.

    parts: texts; owner: the ascending index of whom each part belongs to. A text is
    lower-cased and its words are the runs of a-z0-9; a shingle never spans two parts.
    Returns ascending hashes owner by owner and n_owners + 1 offsets. A text with fewer
    words has none.
    """
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n_owners + 1, np.int64)
    coded = [p.lower().encode("utf-8", "surrogatepass") for p in parts]
    raw = np.frombuffer(b"\x00".join(coded) + b"\x00", np.uint8)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    begins = np.cumsum(lengths) - lengths
    # The text ends outside a word, so the changes alternate between starts and ends.
    inside = _WORD[raw]
    change = np.flatnonzero(np.concatenate((inside[:1], inside[1:] != inside[:-1])))
    start, end = change[::2], change[1::2]
    if len(start) < words:
        return np.zeros(0, np.uint64), np.zeros(n_owners + 1, np.int64)
    up, down = powers(len(raw) + 1)
    part_of = np.searchsorted(begins, start, "right") - 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    last = len(word) - words + 1
    whole = part_of[:last] == part_of[words - 1 :]
    shingle = word[:last].copy()
    for k in range(1, words):
        shingle = mix(shingle * np.uint64(0xD6E8FEB86659FD93) + word[k : last + k])
    shingle, who = shingle[whole], owner[part_of[:last][whole]]
    # One number of the owner's bits and the hash's leading bits; where those tie out of order, both in full.
    bits = np.uint64(max(1, int(n_owners - 1).bit_length()))
    rank = (who.astype(np.uint64) << (np.uint64(64) - bits)) | (shingle >> bits)
    order = np.argsort(rank)
    rank = rank[order]
    if ((rank[1:] == rank[:-1]) & (shingle[order][1:] < shingle[order][:-1])).any():
        order = np.lexsort((shingle, who))
    shingle, who = shingle[order], who[order]
    if len(shingle):
        first = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (who[1:] != who[:-1])))
        shingle, who = shingle[first], who[first]
    return shingle, np.searchsorted(who, np.arange(n_owners + 1))


def set_ids(shingles: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit name of each owner's set, equal for equal sets and salts (as int64).

    Two different sets get one name with probability 2**-64.
    """
    size = np.diff(offsets).astype(np.uint64)
    total = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        total[full] = np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), offsets[:-1][full], dtype=np.uint64)
    return mix(mix(total + salt) + size).view(np.int64)
