"""Words and word shingles of whole batches of texts as numpy hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text hashed together; a longer run without white space is not split.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


def _cut(data: np.ndarray, at: int) -> int:
    """The end of a chunk from at: a place just after white space where there is one, else as far on as needed."""
    end = min(at + CHUNK, len(data))
    if end == len(data):
        return end
    before = np.flatnonzero(_SPACE[data[max(at, end - 65536) : end]])
    if len(before):
        return max(at, end - 65536) + int(before[-1]) + 1
    while end < len(data):
        after = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
        if len(after):
            return end + int(after[0]) + 1
        end = min(end + CHUNK, len(data))
    return end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z lowered, and the text that it stands in; null texts have none."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    starts_of_texts, hashes, owners = offsets[:-1], [], []
    at = int(offsets[0]) if n else 0
    while at < len(data):
        end = _cut(data, at)
        part = data[at:end]
        inside = ~_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(starts_of_texts, (at, end))
        firsts = starts_of_texts[lo:hi] - at
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        if len(starts):
            within = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part)))) if starts[0] == 0 else None
            if within is None:
                within = np.arange(len(part))
                within[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(part))))
            within[~inside] = 0
            value = (_LOWER[part].astype(np.uint64) + np.uint64(1)) * _powers(_BYTE, int(within.max()) + 1)[within]
            value[~inside] = 0
            hashes.append(mix64(np.add.reduceat(value, starts)))
            owners.append(np.searchsorted(starts_of_texts, starts + at, side="right") - 1)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Of texts that start at the same place all but the last are empty, so that the last is the owner.
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words the whole sequence is one, of none there is none."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(counts)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _WORD + words[k : len(words) - size + 1 + k]
        rolled = mix64(rolled)
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            own = np.sort(rolled[end - n : end - size + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif n:
            value = words[end - n : end - n + 1].copy()
            for k in range(1, n):
                value = value * _WORD + words[end - n + k]
            yield mix64(value + np.uint64(n))
        else:
            yield words[:0]
