"""Word shingles of whole batches of texts as 64-bit hashes, with numpy. For use inside tasks."""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at a time.
PART_BYTES = 2_000_000
_FACTOR = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of the kind hash functions use: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of hashed runs of ``n`` words; words are as in ``common.NOT_WORD``, after A-Z became a-z.

    A text of fewer words, but not none, has one shingle of all its words.
    """

    def __init__(self, n: int = 5):
        self.n = n
        code = np.arange(256)
        self.is_word = ~((code <= 0x2F) | ((code >= 0x3A) & (code <= 0x60)) | ((code >= 0x7B) & (code <= 0x7F)))
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.power) < size:
            base, back = np.uint64(_FACTOR), np.uint64(pow(_FACTOR, -1, 1 << 64))
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, back, np.uint64)])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        data = b" ".join(texts).translate(_LOWER) + b" "
        codes = np.frombuffer(data, np.uint8)
        flag = self.is_word[codes]
        change = np.diff(flag.astype(np.int8), prepend=np.int8(0))
        first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        self._powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.byte[codes] * self.power[: len(codes)], out=sums[1:])
        hashes = _mixed((sums[end] - sums[first]) * self.inverse[first])
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        return hashes, np.diff(np.searchsorted(first, starts))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text its distinct shingles, sorted."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        held = 0
        for text in texts:
            part.append((text or "").encode("utf-8", "replace"))
            held += len(part[-1])
            if held >= PART_BYTES:
                out += self._sets(part)
                part, held = [], 0
        return out + self._sets(part) if part else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, counts = self.words(texts)
        n, total = self.n, len(hashes)
        runs = np.zeros(max(0, total - n + 1), np.uint64)
        for i in range(n):
            runs = runs * np.uint64(_FACTOR) + hashes[i : i + len(runs)]
        runs = _mixed(runs)
        out, at = [], 0
        for count in counts.tolist():
            if count >= n:
                out.append(np.unique(runs[at : at + count - n + 1]))
            elif count:
                one = np.zeros(1, np.uint64)
                for h in hashes[at : at + count]:
                    one = one * np.uint64(_FACTOR) + h
                out.append(_mixed(one + np.uint64(count)))
            else:
                out.append(np.empty(0, np.uint64))
            at += count
        return out


def min_hashes(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """One row a set, one 32-bit label a factor: the top half of the smallest product. Sets must not be empty."""
    out = np.empty((len(sets), len(factors)), np.uint32)
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or size + len(sets[upto]) <= 60_000):
            size += len(sets[upto])
            upto += 1
        values = np.concatenate(sets[at:upto])
        starts = np.cumsum([0, *[len(s) for s in sets[at : upto - 1]]])
        for k, factor in enumerate(factors):
            out[at:upto, k] = np.minimum.reduceat(values * factor, starts) >> np.uint64(32)
        at = upto
    return out


def factors(n: int) -> np.ndarray:
    return _mixed(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1)
