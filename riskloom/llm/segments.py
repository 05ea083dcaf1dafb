"""Vectorised text segments with a bounded per-worker cache.

Texts are cut into byte segments wherever a 256 x 256 table says that a cut
between two neighbouring bytes is safe. Segments are hashed with numpy (64-bit
polynomial prefix sums), looked up in an open-addressing table, and only
segments not seen before reach the per-segment function (a tokenizer, a
network). Memory is bounded by the chunk size and by the cache limit; texts of
any length are read whole, chunk by chunk.

Segments of under 8 bytes have keys of their own. For longer ones a hash only
proposes: every hit is compared with the bytes of the segment that was stored, so
segments that share a hash never share a result. Those that do are handled one by
one, outside the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 21
CACHE_LIMIT = 1_000_000
CACHE_BYTES = 1 << 26
COMPARED = 1 << 15  # segments compared, or hashed for a table, at a time
_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) <= n:
        size = ((n >> 16) + 1) << 16  # as long as the texts at hand
        base, inv = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        base[0] = inv[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["p"], _POWERS["i"] = np.cumprod(base), np.cumprod(inv)
        _POWERS["t"] = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    return _POWERS["t"], _POWERS["p"], _POWERS["i"]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return np.where(h == 0, np.uint64(1), h)


def _words(arr: np.ndarray) -> np.ndarray:
    """The bytes as 64-bit words, with room behind the last one."""
    padded = np.zeros(len(arr) // 8 * 8 + 16, np.uint8)
    padded[:len(arr)] = arr
    return padded.view(np.uint64)


def _word_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place ``at``."""
    word, shift = at >> 3, (8 * (at & 7)).astype(np.uint64)
    return (words[word] >> shift) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))


def hash_segments(arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Non-zero 64-bit keys of ``arr[starts[i]:ends[i]]``: under 8 bytes one of its own, else a hash."""
    codes, power, inverse = _powers(len(arr))
    size = ends - starts
    h = np.empty(len(size), np.uint64)
    short, long = np.flatnonzero(size < 8), np.flatnonzero(size >= 8)
    n = size[short].astype(np.uint64)
    own = _word_at(_words(arr), starts[short]) & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1))
    h[short] = own | (n << np.uint64(56))
    if len(long):
        first, n = starts[long], size[long].astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.empty(len(arr) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(codes[arr] * power[: len(arr)], out=sums[1:])
            h[long] = ((sums[ends[long]] - sums[first]) * inverse[first] + n * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1 << 63)
    return _mix(h)


class HashTable:
    """Open addressing over numpy arrays: non-zero uint64 key -> int32."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        out, todo, slot, mask = np.full(len(h), -1, np.int32), np.arange(len(h)), self._slots(h), (1 << self.bits) - 1
        while len(todo):
            k = self.keys[slot]
            hit = k == h
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (k != 0)
            todo, h, slot = todo[go], h[go], (slot[go] + 1) & mask
        return out

    def insert(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        self.count += len(h)
        if 2 * self.count > 1 << self.bits:
            raise ValueError("table is too small")
        slot, mask = self._slots(h), (1 << self.bits) - 1
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            placed = self.keys[slot] == h
            self.values[slot[placed]] = values[placed]
            h, values, slot = h[~placed], values[~placed], (slot[~placed] + 1) & mask

    def clear(self) -> None:
        self.count = 0
        self.keys[:] = 0


class Rows:
    """Growing numpy store of rows."""

    def __init__(self, dtype, width: int | None = None):
        self.dtype, self.width = dtype, width
        self.reset()

    def reset(self) -> None:
        self.n = 0
        self.data = np.zeros(1024 if self.width is None else (1024, self.width), self.dtype)

    def append(self, rows: np.ndarray) -> int:
        need = self.n + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)),) + self.data.shape[1:], self.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n:need] = rows
        self.n = need
        return need - len(rows)


def equal_segments(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether segments of equal keys are equal. Those of at least 8 bytes, in the
    words ``a`` and ``b``, are compared word by word, the last one ending where they end."""
    same = a_len == b_len
    use = np.flatnonzero(same & (a_len >= 8))
    for lo in range(0, len(use), COMPARED):
        pick = use[lo:lo + COMPARED]
        n = (a_len[pick] + 7) >> 3
        stop = np.cumsum(n)
        of = np.repeat(np.arange(len(pick)), n)
        place = np.minimum(8 * (np.arange(stop[-1]) - (stop - n)[of]), (a_len[pick] - 8)[of])
        differs = _word_at(a, place + a_at[pick][of]) != _word_at(b, place + b_at[pick][of])
        if differs.any():
            same[pick[of[differs]]] = False
    return same


class SegmentBytes:
    """Bytes of numbered segments."""

    def __init__(self):
        self.data, self.at, self.size = Rows(np.uint8), Rows(np.int64), Rows(np.int64)

    def reset(self) -> None:
        self.data.reset()
        self.at.reset()
        self.size.reset()

    def append(self, parts: list[bytes]) -> None:
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self.data.append(np.frombuffer(b"".join(parts) + bytes(16), np.uint8))
        self.data.n -= 16  # room behind the last word
        self.at.append(at + np.cumsum(n) - n)
        self.size.append(n)

    def equal(self, arr: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether ``arr[starts[i]:ends[i]]``, of the same key, is segment ``rows[i]``."""
        size = ends - starts
        same = np.ones(len(rows), bool)
        long = np.flatnonzero(size >= 8)
        if len(long):
            held, at = self.data.data, rows[long]
            same[long] = equal_segments(_words(arr), starts[long], size[long], held[:len(held) // 8 * 8].view(np.uint64), self.at.data[at], self.size.data[at])
        return same


class SegmentTable:
    """Number of each of some given segments; -1 for all others."""

    def __init__(self, parts: list[bytes]):
        self.held = SegmentBytes()
        self.held.append(parts)
        at, n = self.held.at.data[:len(parts)], self.held.size.data[:len(parts)]
        hashes = np.zeros(len(parts), np.uint64)
        for lo in range(0, len(parts), COMPARED):  # a hash needs many times the memory of its bytes
            first, size = at[lo:lo + COMPARED], n[lo:lo + COMPARED]
            held = self.held.data.data[first[0]:first[-1] + size[-1]]
            hashes[lo:lo + COMPARED] = hash_segments(held, first - first[0], first - first[0] + size)
        u, first = np.unique(hashes, return_index=True)
        self.table = HashTable(max(4, (4 * len(u)).bit_length()))
        self.table.insert(u, first.astype(np.int32))

    def find(self, arr: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        row = self.table.find(hashes)
        hit = np.flatnonzero(row >= 0)
        row[hit[~self.held.equal(arr, starts[hit], ends[hit], row[hit])]] = -1
        return row


def distinct_segments(buf: bytes, arr: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[bytes, int]:
    """Occurrences of each distinct segment."""
    _, first, back, n = np.unique(hash_segments(arr, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    words = _words(arr)
    same = equal_segments(words, starts, ends - starts, words, starts[first][back], (ends - starts)[first][back])
    if not same.all():
        n = np.bincount(back[same], minlength=len(first))
    found = dict(zip((buf[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())), n.tolist()))
    for s, e in zip(starts[~same].tolist(), ends[~same].tolist()):
        found[buf[s:e]] = found.get(buf[s:e], 0) + 1
    return found


class SegmentCache:
    """Segment -> row number of a store kept by the caller.

    ``encode(list[bytes]) -> first row`` appends one row per segment to the
    store, whose rows count from 0; ``reset()`` empties it. Both are called only here."""

    def __init__(self, encode: Callable[[list[bytes]], int], reset: Callable[[], None], limit: int = CACHE_LIMIT):
        self.encode, self.reset, self.limit = encode, reset, limit
        self.table = HashTable(max(12, (4 * limit - 1).bit_length()))
        self.held = SegmentBytes()

    def _add(self, parts: list[bytes]) -> np.ndarray:
        self.held.append(parts)
        row = self.encode(parts)
        return np.arange(row, row + len(parts), dtype=np.int32)

    def rows(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, miss: np.ndarray | None = None) -> np.ndarray:
        """Row of each segment; ``miss`` restricts the lookup to some of them (others get -1)."""
        if self.held.size.n > self.limit or self.held.data.n > CACHE_BYTES:
            self.table.clear()
            self.held.reset()
            self.reset()
        out = np.full(len(hashes), -1, np.int32)
        sel = np.arange(len(hashes)) if miss is None else miss
        out[sel] = self.table.find(hashes[sel])
        new = sel[out[sel] < 0]
        for at in range(0, len(new), self.limit):  # a chunk never holds more than that in practice
            part = new[at:at + self.limit]
            known = self.table.find(hashes[part])
            out[part[known >= 0]] = known[known >= 0]
            part = part[known < 0]
            if not len(part):
                continue
            u, first, inv = np.unique(hashes[part], return_index=True, return_inverse=True)
            at_s, at_e = starts[part[first]].tolist(), ends[part[first]].tolist()
            got = self._add([buf[s:e] for s, e in zip(at_s, at_e)])
            if 2 * (self.table.count + len(u)) <= 1 << self.table.bits:
                self.table.insert(u, got)
            out[part] = got[inv]
        other = sel[~self.held.equal(np.frombuffer(buf, np.uint8), starts[sel], ends[sel], out[sel])]
        if len(other):  # another segment has the hash
            parts = [buf[s:e] for s, e in zip(starts[other].tolist(), ends[other].tolist())]
            number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
            out[other] = self._add(list(number))[[number[p] for p in parts]]
        return out


def cuts(pieces: list[bytes], cut: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of several texts: (buffer, bytes, starts, ends, text number).

    Segments cover each text in order and never span two texts."""
    buf = b"\n".join(pieces) + b"\n"
    arr = np.frombuffer(buf, np.uint8)
    at = np.zeros(len(arr), bool)
    at[1:] = cut[arr[:-1], arr[1:]]
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.concatenate([[0], np.cumsum(lens + 1)])
    at[first[:-1]] = True
    at[first[1:] - 1] = True  # the joints
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], len(arr))
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, first[1:] - 1)] = False
    starts, ends = starts[own], ends[own]
    return buf, arr, starts, ends, np.searchsorted(first, starts, side="right") - 1


def chunks(texts: list[bytes], cut: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(text numbers, pieces) of about ``size`` bytes; long texts are divided at safe cuts."""
    ids: list[int] = []
    held: list[bytes] = []
    total = 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > size:
                arr = np.frombuffer(t, np.uint8, offset=at)
                safe = np.flatnonzero(cut[arr[size // 2:-1], arr[size // 2 + 1:]])
                if len(safe):  # the last safe cut within the size, else the first beyond it
                    inside = safe[safe + size // 2 + 1 <= size]
                    end = at + int(inside[-1] if len(inside) else safe[0]) + size // 2 + 1
            if held and total + end - at > size:
                yield np.array(ids), held
                ids, held, total = [], [], 0
            ids.append(i)
            held.append(t[at:end])
            total += end - at + 1
            at = end
            if at >= len(t):
                break
    if held:
        yield np.array(ids), held


def class_cuts(kind: np.ndarray) -> np.ndarray:
    """Cut table from a class per byte: cut where the class changes."""
    return kind[:, None] != kind[None, :]
