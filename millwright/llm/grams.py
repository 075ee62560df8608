"""Runs of words of whole batches of texts, interned by their bytes in NumPy tables. For use inside tasks.

``split`` lays the words of a batch out in one buffer, one space after each, so that every run of words within a piece
is a slice of it. ``Table`` interns slices: an open-addressed table under their xxhash64, with linear probing; a slice
joins a slot only if its bytes (and its tag) are those of the slot's first slice, so no two runs are ever confused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Kinds of bytes: part of a word, between words, between pieces.
WORD, BLANK, CUT = 0, 1, 2
#: Bytes of text worked on at a time; a longer text is worked on whole.
PART_BYTES = 1_000_000

_MASK = (1 << 64) - 1
# Fixed values of the xxhash64 specification.
_P1, _P2, _P3, _P4, _P5 = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)


def kinds(blank: Iterable[int], cut: Iterable[int] = ()) -> np.ndarray:
    """The kind of every byte."""
    out = np.full(256, WORD, np.uint8)
    out[list(blank)] = BLANK
    out[list(cut)] = CUT
    return out


@dataclass
class Words:
    """The words of a batch: ``data[first:end]`` each; their text's number; words of one piece share ``piece``."""

    data: np.ndarray
    first: np.ndarray
    end: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def runs(self, n: int) -> np.ndarray:
        """Places of the words at which a run of ``n`` words of one piece starts."""
        if len(self.piece) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])


def parts(texts: list[str | None], size: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 (NULL: empty), about ``size`` bytes together; with the number of the first."""
    first, part, held = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if part and held + len(raw) > size:
            yield first, part
            first, part, held = k, [], 0
        part.append(raw)
        held += len(raw) + 1
    if part:
        yield first, part


def split(texts: list[bytes], kind: np.ndarray) -> Words:
    """The words of the texts, after A-Z became a-z; no piece goes beyond its text. A blank must be a blank in ``kind``."""
    codes = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    of = kind[codes]
    keep = of == WORD
    change = np.diff(keep.view(np.int8), prepend=np.int8(0))
    first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    text = np.searchsorted(starts, first, "right") - 1
    piece = text
    cut = np.flatnonzero(of == CUT)
    if len(cut):
        piece = text + np.searchsorted(cut, first)
    keep[end] = True  # the byte behind a word becomes its space
    length = end - first
    new_end = np.cumsum(length + 1) - 1
    kept = codes[keep]
    data = np.zeros(len(kept) + 8, np.uint8)  # whole lanes can be read at any place
    data[: len(kept)] = kept
    data[new_end] = 0x20
    return Words(data, new_end - length, new_end, text, piece)


def _lanes(data: np.ndarray, size: int) -> np.ndarray:
    """The little-endian number in ``size`` bytes from every place."""
    return np.ndarray(len(data) - size + 1, f"<u{size}", data, strides=(1,))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * np.uint64(_P2), 31) * np.uint64(_P1)


def xxhash64(data: np.ndarray, first: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the slices, all at once. ``data`` has seven bytes or more behind the last slice."""
    eight, four = _lanes(data, 8), _lanes(data, 4)
    at, left = first.copy(), length.copy()
    h = np.full(len(first), (seed + _P5) & _MASK, np.uint64)
    long = np.flatnonzero(length >= 32)
    if len(long):
        start = [(seed + _P1 + _P2) & _MASK, (seed + _P2) & _MASK, seed & _MASK, (seed - _P1) & _MASK]
        acc = [np.full(len(long), s, np.uint64) for s in start]
        live = np.arange(len(long))
        while len(live):
            row = long[live]
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[at[row] + 8 * k])
            at[row] += 32
            left[row] -= 32
            live = live[left[row] >= 32]
        total = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
        for k in range(4):
            total = (total ^ _round(np.uint64(0), acc[k])) * np.uint64(_P1) + np.uint64(_P4)
        h[long] = total
    h += length.astype(np.uint64)
    live = np.flatnonzero(left >= 8)
    while len(live):
        h[live] = _rotated(h[live] ^ _round(np.uint64(0), eight[at[live]]), 27) * np.uint64(_P1) + np.uint64(_P4)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    if len(live):
        lane = four[at[live]].astype(np.uint64) * np.uint64(_P1)
        h[live] = _rotated(h[live] ^ lane, 23) * np.uint64(_P2) + np.uint64(_P3)
        at[live] += 4
        left[live] -= 4
    live = np.flatnonzero(left > 0)
    while len(live):
        h[live] = _rotated(h[live] ^ (data[at[live]].astype(np.uint64) * np.uint64(_P5)), 11) * np.uint64(_P1)
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P3)
    return h ^ (h >> np.uint64(32))


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (reflected polynomial EDB88320)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return step


def crc32(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices, as zlib's, all at once."""
    steps = _crc_steps()
    out = np.full(len(first), 0xFFFFFFFF, np.uint32)
    live, done = np.flatnonzero(length > 0), 0
    while len(live):
        so_far = out[live]
        out[live] = steps[(so_far ^ data[first[live] + done]) & np.uint32(255)] ^ (so_far >> np.uint32(8))
        done += 1
        live = live[length[live] > done]
    return ~out


def _equal(data: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether slices of the same length have the same bytes."""
    eight = _lanes(data, 8)
    out = np.ones(len(one), bool)
    live, done = np.arange(len(one)), 0
    while len(live):
        rest = np.minimum(length[live] - done, 8)
        differ = (eight[one[live] + done] ^ eight[other[live] + done]) << ((8 - rest) * 8).astype(np.uint64)
        out[live[differ != 0]] = False
        done += 8
        live = live[(differ == 0) & (length[live] > done)]
    return out


class Table:
    """The distinct slices of a batch. ``slots`` gives every slice its slot, ``owner`` every taken slot a slice."""

    def __init__(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, tag: np.ndarray | None = None):
        size = len(first)
        key = xxhash64(data, first, length)
        if tag is not None:
            key ^= tag.astype(np.uint64) * np.uint64(_P3)
        room = 1 << max(4, (2 * size - 1).bit_length())
        owner = np.full(room, -1, np.int64)
        at = (key & np.uint64(room - 1)).astype(np.int64)
        slots, left = np.empty(size, np.int64), np.arange(size)
        while len(left):
            here = at[left]
            free = owner[here] < 0
            owner[here[free]] = left[free]  # of several that claim a slot, one has it
            who = owner[here]
            same = (key[who] == key[left]) & (length[who] == length[left])
            if tag is not None:
                same &= tag[who] == tag[left]
            alike = np.flatnonzero(same & (who != left))
            same[alike] = _equal(data, first[who[alike]], first[left[alike]], length[left[alike]])
            slots[left[same]] = here[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (room - 1)
        taken = np.flatnonzero(owner >= 0)
        place = np.empty(room, np.int64)  # slots are numbered without gaps
        place[taken] = np.arange(len(taken))
        self.owner, self.slots = owner[taken], place[slots] if size else slots
        self.count = np.bincount(self.slots, minlength=len(taken))
