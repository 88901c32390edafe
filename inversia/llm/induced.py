"""Suffix sorting with common prefixes by external induced sorting, in numpy.

Suffixes that sort below their right neighbour are S, others L. The order of all follows from the
order of the leftmost S ones (LMS): a scan upwards appends the L suffix left of each one scanned to
the queue of its first byte, and a scan downwards does the same for S suffixes. Queues are served
by first byte, then in the order of arrival, which is the priority of the suffix they came from.
They carry suffixes with the length of the prefix shared with the one queued before: one more than
the least length met between the two suffixes they came from.

The order of LMS suffixes comes from a first induction that sorts the pieces between them, from
the names of those pieces, and from sorting the sequence of names (by doubling of ranks, since it
has more names than a byte).

Queues hold MEMORY bytes and put what is above that into a file of the task's own without a name,
which is gone with the task. In memory stay the text, a byte of type for each of its bytes, the
LMS positions, and the queue being served. Prefixes are told up to ``cap`` only."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 16 << 20
BATCH = 1 << 18


class Queues:
    """A queue of (position, shared prefix) for each first byte, on disk beyond ``memory`` bytes."""

    def __init__(self, memory: int = MEMORY):
        self._parts: list[list] = [[] for _ in range(256)]
        self._memory, self._held, self._file = memory, 0, None

    def put(self, byte: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self._parts[byte].append((positions, shared))
        self._held += positions.nbytes + shared.nbytes
        if self._held > self._memory:
            self._spill()

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that is queued for this byte now, in order."""
        parts, self._parts[byte] = self._parts[byte], []
        if not parts:
            return None
        loaded = [self._load(p) for p in parts]
        return np.concatenate([p[0] for p in loaded]), np.concatenate([p[1] for p in loaded])

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        self._file.seek(0, 2)
        for parts in self._parts:
            held = [p for p in parts if isinstance(p[0], np.ndarray)]
            if held:
                place, n = self._file.tell(), sum(len(p[0]) for p in held)
                self._file.write(np.concatenate([p[0] for p in held]).tobytes())
                self._file.write(np.concatenate([p[1] for p in held]).tobytes())
                # what was on disk before came before
                parts[:] = [p for p in parts if not isinstance(p[0], np.ndarray)] + [(place, n)]
        self._held = 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            self._held -= part[0].nbytes + part[1].nbytes
            return part
        place, n = part
        self._file.seek(place)
        positions = np.frombuffer(self._file.read(8 * n), np.int64)
        return positions, np.frombuffer(self._file.read(n), np.uint8)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class SuffixSorter:
    """Suffixes of ``text`` (uint8) in descending order with prefixes shared up to ``cap`` (< 255)."""

    def __init__(self, text: np.ndarray, cap: int, memory: int = MEMORY):
        self.text, self.cap, self.memory, self.n = text, cap, memory, len(text)
        self._padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
        self.is_s = np.zeros(self.n, bool)  # the last byte is followed by the end, the least of all
        for end in range(self.n - 1, 0, -BATCH):
            start = max(0, end - BATCH)
            here, right = text[start:end], text[start + 1 : end + 1]
            place = np.where(here != right, np.arange(end - start), end - start)
            following = np.minimum.accumulate(place[::-1])[::-1]  # where the run of equal bytes ends
            self.is_s[start:end] = np.append(here < right, self.is_s[end])[following]
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, prefix shared with the position before in this order), in blocks."""
        order = self._order_of_lms()
        shared = np.zeros(len(order), np.uint8)
        for i in range(1, len(order), BATCH):
            j = min(len(order), i + BATCH)
            shared[i:j] = self.shared_prefix(order[i - 1 : j - 1], order[i:j])
        yield from self._induce(order, shared)

    def shared_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, up to ``cap`` and the text's end."""
        limit = np.minimum(self.cap, self.n - np.maximum(a, b))
        found = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        for k in range(self.cap):
            open_ = open_[limit[open_] > k]
            open_ = open_[self._padded[a[open_] + k] == self._padded[b[open_] + k]]
            if not len(open_):
                break
            found[open_] = k + 1
        return found.astype(np.uint8)

    def _order_of_lms(self) -> np.ndarray:
        """LMS positions in the order of their suffixes, as far as ``cap`` bytes tell."""
        if not len(self.lms):
            return self.lms
        by_byte = self.lms[np.argsort(self.text[self.lms], kind="stable")]
        is_lms = np.zeros(self.n, bool)
        is_lms[self.lms] = True
        pieces = np.concatenate([p[is_lms[p]] for p, _ in self._induce(by_byte, None)])[::-1]
        place = np.empty(self.n, np.int32)
        place[self.lms] = np.arange(len(self.lms), dtype=np.int32)
        number = place[pieces]
        del place, is_lms
        ends = np.append(self.lms[1:], self.n)
        lengths = (ends - self.lms + 1)[number]
        new = np.ones(len(pieces), bool)
        new[1:] = ~self._same(pieces[:-1], pieces[1:], lengths[:-1], lengths[1:])
        rank = np.empty(len(pieces), np.int64)
        rank[number] = np.cumsum(new)
        step = 1
        # pieces are two bytes at least
        while 2 * step <= self.cap + 2 and rank.max() < len(rank):
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
            step *= 2
        return self.lms[np.argsort(rank, kind="stable")]

    def _same(self, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
        same = (length_a == length_b) & (a + length_a <= self.n) & (b + length_b <= self.n)
        open_ = np.flatnonzero(same)
        k = 0
        while len(open_):
            equal = self._padded[a[open_] + k] == self._padded[b[open_] + k]
            same[open_[~equal]] = False
            k += 1
            open_ = open_[equal]
            open_ = open_[length_a[open_] > k]
        return same

    def _induce(self, lms: np.ndarray, shared: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes downwards, from LMS ones in order; without ``shared``, prefixes mean nothing."""
        tell = shared is not None
        if shared is None:
            shared = np.zeros(len(lms), np.uint8)
        bounds = np.searchsorted(self.text[lms], np.arange(257))
        queue, found = Queues(self.memory), Queues(self.memory)
        since = np.full(256, -1, np.int64)  # least prefix met since the last one queued; -1: none yet
        queue.put(int(self.text[-1]), np.array([self.n - 1]), np.zeros(1, np.uint8))
        since[self.text[-1]] = self.cap
        for byte in range(256):
            last = -1
            while (items := queue.take(byte)) is not None:
                found.put(byte, *items)
                self._queue_left(queue, *items, since, False, tell)
                last = int(items[0][-1])
            low, high = bounds[byte], bounds[byte + 1]
            if low < high:
                own = shared[low:high].copy()
                own[0] = self._one_shared(last, int(lms[low])) if last >= 0 and tell else 0
                self._queue_left(queue, lms[low:high], own, since, False, tell)
        queue.close()
        queue, since = Queues(self.memory), np.full(256, -1, np.int64)
        for byte in range(255, -1, -1):
            last = -1
            while (items := queue.take(byte)) is not None:
                yield items
                self._queue_left(queue, *items, since, True, tell)
                last = int(items[0][-1])
            if (items := found.take(byte)) is not None:
                positions = items[0][::-1]
                own = np.empty(len(positions), np.uint8)
                own[1:] = items[1][:0:-1]
                own[0] = self._one_shared(last, int(positions[0])) if last >= 0 and tell else 0
                yield positions, own
                self._queue_left(queue, positions, own, since, True, tell)
        queue.close()
        found.close()

    def _one_shared(self, a: int, b: int) -> int:
        return int(self.shared_prefix(np.array([a]), np.array([b]))[0])

    def _queue_left(self, queue: Queues, positions: np.ndarray, shared: np.ndarray, since: np.ndarray, s: bool, tell: bool) -> None:
        for i in range(0, len(positions), BATCH):
            self._queue_batch(queue, positions[i : i + BATCH], shared[i : i + BATCH], since, s, tell)

    def _queue_batch(self, queue: Queues, positions: np.ndarray, shared: np.ndarray, since: np.ndarray, s: bool, tell: bool) -> None:
        left = positions - 1
        index = np.flatnonzero((left >= 0) & (self.is_s[left] == s))
        seen = since >= 0
        if not len(index):
            if tell:
                since[seen] = np.minimum(since[seen], shared.min())
            return
        byte = self.text[left[index]]
        order = np.argsort(byte, kind="stable")
        index, byte = index[order], byte[order]
        starts = np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1])
        ends = np.append(starts[1:], len(index))
        values = np.zeros(len(index), np.uint8)
        if tell:
            extended = np.append(shared, np.uint8(self.cap))
            spans = np.empty(2 * len(index), np.int64)
            spans[2::2] = index[:-1] + 1
            spans[2 * starts] = 0
            spans[1::2] = index + 1
            least = np.minimum.reduceat(extended, spans)[::2].astype(np.int64)
            own = byte[starts]
            before = since[own]
            least[starts] = np.where(before < 0, -1, np.minimum(least[starts], before))
            values = np.minimum(least + 1, self.cap).astype(np.uint8)
            after = np.minimum.accumulate(extended[::-1])[::-1]
            since[seen] = np.minimum(since[seen], after[0])
            since[own] = after[index[ends - 1] + 1]
        left = left[index]
        for b, i, j in zip(byte[starts].tolist(), starts.tolist(), ends.tolist()):
            queue.put(b, left[i:j], values[i:j])
