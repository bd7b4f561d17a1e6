"""External induced sorting of one shard's suffixes, with common-prefix values carried along.

The shard is a row of byte strings, each closed by a sentinel. Suffixes are L (greater than the next) or S; the
leftmost S of each run, S*, are sorted first: a first induction orders the S* substrings, equal ones get equal
names, and the string of names is sorted in the same way, by recursion, until all names differ. A second induction,
from the sorted S*, orders the L suffixes in ascending and the S suffixes in descending order, each from the suffix
that follows it.

All inductions run on priority queues of (leading symbol, rank of the next suffix): entries of a symbol are put in
the order of rank, so that a queue for each symbol, first in first out, always gives the least. Of names there may be
as many as suffixes; there a queue serves a range of them, and what a range induces in itself is ranked by doubling.
A queue holds positions and the common prefix with its last entry, and once `memory` entries are
held in all, they go to disk, in one file for all queues, of which each later reads its part. The common prefix of
two neighbours is 1 + the least of those between the suffixes that follow them; that of S* neighbours, from which it
starts, is compared.

Common prefixes are kept up to 255. The shard's symbols and their types stay in memory, as do, one level at a time,
S* positions and names; the suffixes do not.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable

import numpy as np
from pyarrow.fs import FileSystem

SYMBOLS = 257  # 0 is the sentinel, a byte b is b + 1


class Queues:
    """Entries (position, common prefix) for each of `n` queues; on disk beyond `memory` entries."""

    def __init__(self, folder: str, memory: int, n: int = SYMBOLS):
        self.fs, path = FileSystem.from_uri(folder)
        self.path = f"{path}/queue-{uuid.uuid4().hex}"
        self.memory, self.held, self.files = memory, 0, 0
        self.chunks: list[deque] = [deque() for _ in range(n)]

    def put(self, queue: int, position: np.ndarray, common: np.ndarray) -> None:
        self.chunks[queue].append((position, common))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Writes what all queues hold to one file; a queue's part stands after those that it has on disk already."""
        if not self.files:
            self.fs.create_dir(self.path, recursive=True)
        name, at = f"{self.path}/{self.files}", 0
        self.files += 1
        with self.fs.open_output_stream(name) as out:
            for queue in self.chunks:
                inside = []
                while queue and len(queue[-1]) == 2:
                    inside.append(queue.pop())
                if not inside:
                    continue
                position, common = (np.concatenate(x) for x in zip(*reversed(inside), strict=True))
                out.write(position.astype(np.int64).tobytes() + common.tobytes())
                queue.append((name, at, len(position)))
                at += 9 * len(position)
        self.held = 0

    def take(self, queue: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next chunk of the queue's entries, in order; None when there are none for now."""
        if not self.chunks[queue]:
            return None
        entry = self.chunks[queue].popleft()
        if len(entry) == 3:
            name, at, n = entry
            with self.fs.open_input_file(name) as f:
                data = f.read_at(9 * n, at)
            return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint8, n, 8 * n)
        self.held -= len(entry[0])
        return entry

    def take_all(self, queue: int) -> np.ndarray:
        """Positions of all the queue's entries, in order."""
        out = []
        while (got := self.take(queue)) is not None:
            out.append(got[0])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.files:
            self.fs.delete_dir(self.path)


def types_of(s: np.ndarray) -> np.ndarray:
    """True at S suffixes of s, whose end is less than all symbols, and at its end."""
    n = len(s)
    known = np.where(s[:-1] == s[1:], n, np.arange(n - 1)) if n > 1 else np.zeros(0, np.int64)
    following = np.minimum.accumulate(known[::-1])[::-1]
    small = np.ones(n + 1, bool)
    if n:
        at = np.minimum(following, n - 2)
        small[: n - 1] = (following < n) & (s[at] < s[np.minimum(at + 1, n - 1)])
        small[n - 1] = False
    return small


def _neighbours_equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b, with the symbol after each, are equal; s is read as -1 beyond its end."""
    padded = np.append(s, -1)
    same = np.flatnonzero(length_a == length_b)
    equal, k = np.zeros(len(a), bool), 0
    while len(same):
        agree = padded[np.minimum(a[same] + k, len(s))] == padded[np.minimum(b[same] + k, len(s))]
        done = agree & (k == length_a[same])
        equal[same[done]] = True
        same = same[agree & ~done]
        k += 1
    return equal


class Names:
    """A string of whole numbers 0 .. most, and the order of its suffixes by induction; its end is the least."""

    def __init__(self, s: np.ndarray, folder: str, memory: int):
        self.s, self.folder, self.memory, self.n = s, folder, memory, len(s)
        self.small = types_of(s)
        most = int(s.max()) + 1
        self.width = -(-most // max(1, min(256, self.n // 4096)))  # symbols of a queue
        self.ranges = -(-most // self.width)
        # where neighbours of one type and range begin, from which each entry before them is induced in its own range
        kind = s // self.width * 2 + self.small[: self.n]
        self.begin = np.maximum.accumulate(np.where(np.append(True, kind[1:] != kind[:-1]), np.arange(self.n), 0))
        self.rank = np.zeros(self.n + 1, np.int64)

    def _settled(self, queued: np.ndarray, known: np.ndarray, low: int, ascending: bool) -> np.ndarray:
        """Positions of one range's suffixes in order (greatest first if not ascending). Of a symbol come first those
        queued by other ranges, then those that the range induces in itself, by the rank of the next suffix, then the known
        ones. The second kind stands in chains before entries of the others, which give their ranks by doubling."""
        entries = np.concatenate((queued, known))
        before = entries[entries > 0] - 1
        symbol = self.s[before]
        before = before[(self.small[before] != ascending) & (symbol >= low) & (symbol < low + self.width)]
        length = before + 1 - self.begin[before]
        own = np.repeat(before + 1, length) - np.arange(1, int(length.sum()) + 1) + np.repeat(np.cumsum(length) - length, length)
        position = np.concatenate((queued, own, known))
        symbol = self.s[position] - low
        symbol = symbol if ascending else self.width - symbol
        order = np.argsort(symbol.astype(np.uint16) if self.width < 1 << 16 else symbol, kind="stable")
        position, symbol = position[order], symbol[order]
        if not len(own):
            return position
        # neighbours of one symbol in the second kind share a rank, the place of their first, until they are told apart
        inner = (order >= len(queued)) & (order < len(queued) + len(own))
        fresh = np.ones(len(position), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | ~inner[1:] | ~inner[:-1]
        self.rank[position] = np.maximum.accumulate(np.where(fresh, np.arange(len(position)), 0))
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        step = 1
        while len(tied):
            at = position[tied]
            group, following = self.rank[at], self.rank[at + step]
            order = np.lexsort((following, group))
            at, group, following = at[order], group[order], following[order]
            position[tied] = at
            fresh = np.ones(len(tied), bool)
            fresh[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
            self.rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
            tied = tied[~fresh | np.append(~fresh[1:], False)]
            step *= 2
        return position

    def _put(self, queues: Queues, position: np.ndarray, here: int, ascending: bool) -> None:
        before = position[position > 0] - 1
        before = before[self.small[before] != ascending]
        queue = self.s[before] // self.width
        away = queue != here
        before, queue = before[away], queue[away]
        order = np.argsort(queue.astype(np.uint16), kind="stable")
        before, queue = before[order], queue[order]
        cuts = np.concatenate(([0], np.flatnonzero(queue[1:] != queue[:-1]) + 1, [len(queue)]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < z:
                queues.put(int(queue[a]), before[a:z], np.zeros(z - a, np.uint8))

    def _induced(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in order, from S* suffixes in order."""
        up, kept, down = (Queues(self.folder, self.memory, self.ranges) for _ in range(3))
        cut = np.searchsorted(self.s[seeds] // self.width, np.arange(self.ranges + 1))
        try:
            self._put(up, np.array([self.n]), -1, True)
            for k in range(self.ranges):
                position = self._settled(up.take_all(k), seeds[cut[k] : cut[k + 1]], k * self.width, True)
                self._put(up, position, k, True)
                large = position[~self.small[position]]
                kept.put(k, large[::-1], np.zeros(len(large), np.uint8))
            out: list[np.ndarray] = []
            for k in range(self.ranges - 1, -1, -1):
                position = self._settled(down.take_all(k), kept.take_all(k), k * self.width, False)
                self._put(down, position, k, False)
                out.append(position)
            return np.concatenate(out)[::-1]
        finally:
            for queues in (up, kept, down):
                queues.close()

    def order(self) -> np.ndarray:
        if self.n < 2 or len(np.unique(self.s)) == self.n:
            return np.argsort(self.s, kind="stable")
        seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        seeds = seeds[seeds < self.n]
        if len(seeds) > 1:
            loose = self._induced(seeds[np.argsort(self.s[seeds], kind="stable")])
            seeds = seeds[named_order(self.s, seeds, loose, self.n, self.folder, self.memory)]
        return self._induced(seeds)


def named_order(s: np.ndarray, seeds: np.ndarray, loose: np.ndarray, n: int, folder: str, memory: int) -> np.ndarray:
    """Numbers of the S* suffixes in order, from an order of all suffixes in which S* substrings are sorted."""
    number = np.full(n + 1, -1, np.int64)
    number[seeds] = np.arange(len(seeds))
    order = number[loose]
    order = order[order >= 0]
    length = np.append(seeds[1:], n) - seeds
    a, b = order[:-1], order[1:]
    name = np.empty(len(seeds), np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~_neighbours_equal(s, seeds[a], seeds[b], length[a], length[b]))))
    return Names(name, folder, memory).order()


class RangeMinimum:
    """Least of any range of a row of bytes, by tables over powers of two, which stand one after another."""

    def __init__(self, values: np.ndarray):
        levels, width, self.begin = [values], 1, [0]
        while 2 * width <= len(values):
            last = levels[-1]
            self.begin.append(self.begin[-1] + len(last))
            levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.table, self.begin = np.concatenate(levels), np.array(self.begin)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first .. last], inclusive."""
        level = np.frexp(last - first + 1)[1] - 1
        begin = self.begin[level]
        return np.minimum(self.table[begin + first], self.table[begin + last - (1 << level) + 1])


class Shard:
    def __init__(self, strings: list[np.ndarray], folder: str, memory: int, depth: int):
        self.depth, self.folder, self.memory = depth, folder, memory
        lengths = np.array([len(x) for x in strings], np.int64)
        self.start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.n = int((lengths + 1).sum())
        self.text = np.zeros(self.n + 1, np.uint16)  # and a last sentinel
        inside = np.ones(self.n, bool)
        inside[self.start + lengths] = False
        if strings:
            self.text[:-1][inside] = np.concatenate(strings).astype(np.uint16) + 1
        self._types()
        # four symbols from each position on as one number, over the same memory, for comparing suffixes directly
        padded = np.concatenate((self.text, np.zeros(depth + 8, np.uint16)))
        self.fours = np.ndarray((self.n + depth + 4,), np.uint64, padded.data, strides=(2,))

    def _types(self) -> None:
        t = self.text
        less, equal = t[:-1] < t[1:], t[:-1] == t[1:]
        # a position takes the type of the next one that differs from its neighbour
        known = np.where(equal, self.n, np.arange(self.n))
        following = np.minimum.accumulate(known[::-1])[::-1]
        self.small = np.ones(self.n + 1, bool)
        at = np.minimum(following, self.n - 1)
        self.small[:-1] = np.where(following < self.n, less[at], True)
        self.seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, up to `depth`, four symbols at a time of those that still agree."""
        out = np.zeros(len(a), np.uint8)
        alive, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        for k in range(0, self.depth, 4):
            differ = self.fours[a + k] ^ self.fours[b + k]
            same = differ == 0
            if not same.all():
                d = differ[~same]
                more = sum(((d & np.uint64((1 << 16 * i) - 1)) == 0).astype(np.uint8) for i in (1, 2, 3))
                out[alive[~same]] = np.minimum(k + more, self.depth)
                alive, a, b = alive[same], a[same], b[same]
            if not len(alive):
                return out
        out[alive] = self.depth
        return out

    def _scan(self, ascending: bool, queues: Queues, known: Callable, emit: Callable | None, values: bool) -> None:
        """Takes symbols in order; of each, the queue's entries and what `known` has of it; puts what they induce."""
        carry = np.full(SYMBOLS, 255, np.uint8)
        text = self.text
        last = -1  # position that was taken last, and its symbol
        for symbol in range(SYMBOLS) if ascending else range(SYMBOLS - 1, -1, -1):
            for kind in ("queue", "known"):
                fresh = True  # the next entry's neighbour was not its neighbour when it was put
                chunks = [] if kind == "queue" else list(known(symbol))
                while True:
                    got = queues.take(symbol) if kind == "queue" else (chunks.pop(0) if chunks else None)
                    if got is None:
                        break
                    position, common = got
                    if not len(position):
                        continue
                    if values and fresh:
                        common = common.copy()
                        common[0] = self.common(position[:1], np.array([last]))[0] if last >= 0 and text[last] == symbol else 0
                    fresh = False
                    if emit:
                        emit(position, common, kind)
                    self._induce(position, common, carry, queues, ascending, values)
                    last = int(position[-1])

    def _induce(self, position: np.ndarray, common: np.ndarray, carry: np.ndarray, queues: Queues, ascending: bool, values: bool) -> None:
        before = position - 1
        fits = (position > 0) & (self.small[before] != ascending)
        at = np.flatnonzero(fits)
        if not len(at):
            if values:
                np.minimum(carry, common.min(), out=carry)
            return
        before = before[at]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol, at = before[order], symbol[order], at[order]
        cuts = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)]))
        lcp = np.zeros(len(before), np.uint8)
        if values:
            ranges = RangeMinimum(common)
            first = cuts[:-1]
            previous = np.concatenate(([-1], at[:-1]))
            previous[first] = -1
            least = ranges.of(previous + 1, at)
            least[first] = np.minimum(least[first], carry[symbol[first]])
            lcp = np.minimum(least, 254) + np.uint8(1)
            np.minimum(carry, common.min(), out=carry)
            tail = at[cuts[1:] - 1]
            more = tail + 1 < len(common)
            rest = np.full(len(tail), 255, np.uint8)
            if more.any():
                rest[more] = ranges.of(tail[more] + 1, np.full(int(more.sum()), len(common) - 1))
            carry[symbol[first]] = rest
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            queues.put(int(symbol[a]), before[a:z], lcp[a:z])

    def _induction(self, seeds: np.ndarray, common: np.ndarray, values: bool, out: Callable) -> None:
        """From S* suffixes in order (seeds), all suffixes: out(position, common) from the greatest to the least."""
        symbol = self.text[seeds]
        cut = np.searchsorted(symbol, np.arange(SYMBOLS + 1))
        kept = Queues(self.folder, self.memory)  # L suffixes by symbol, ascending
        queues = Queues(self.folder, self.memory)
        try:
            self._scan(True, queues, lambda c: [(seeds[cut[c] : cut[c + 1]], common[cut[c] : cut[c + 1]])], lambda p, x, kind: kept.put(int(self.text[p[0]]), p, x) if kind == "queue" else None, values)

            def descending(c: int):
                chunks = []
                while (got := kept.take(c)) is not None:
                    chunks.append(got)
                if not chunks:
                    return []
                position, x = (np.concatenate(k) for k in zip(*chunks, strict=True))
                # from the greatest down, an entry's neighbour is the one that followed it
                return [(position[::-1], np.concatenate((x[1:], np.zeros(1, np.uint8)))[::-1])]

            def known(c: int):
                got = descending(c)
                # the sentinels are S* without a next suffix to come from
                return [*([(seeds[cut[0] : cut[1]][::-1], np.zeros(cut[1] - cut[0], np.uint8))] if c == 0 else []), *got]

            self._scan(False, queues, known, lambda p, x, kind: out(p, x), values)
        finally:
            kept.close()
            queues.close()

    def _sorted_seeds(self) -> np.ndarray:
        """S* suffixes in order."""
        seeds = self.seeds
        if len(seeds) < 2:
            return seeds
        # first induction: the order of S* substrings
        loose = seeds[np.argsort(self.text[seeds], kind="stable")]
        is_seed = np.zeros(self.n + 1, bool)
        is_seed[seeds] = True
        found: list[np.ndarray] = []
        self._induction(loose, np.zeros(len(loose), np.uint8), False, lambda p, x: found.append(p[is_seed[p]]))
        order = np.concatenate(found)[::-1]
        return seeds[named_order(self.text[: self.n].astype(np.int32), seeds, order, self.n, self.folder, self.memory)]

    def repeated(self) -> np.ndarray:
        """True at each position whose first `depth` bytes lie in its string and occur at another position too."""
        hit = np.zeros(self.n + 1, bool)
        seeds = self._sorted_seeds()
        if not len(seeds):
            return hit
        common = np.concatenate((np.zeros(1, np.uint8), self.common(seeds[1:], seeds[:-1])))
        last = np.full(1, -1, np.int64)

        def out(position: np.ndarray, x: np.ndarray) -> None:
            same = x >= self.depth
            hit[position[same]] = True
            before = np.concatenate((last, position[:-1]))
            hit[before[same]] = True
            last[0] = position[-1]

        self._induction(seeds, common, True, out)
        # a sentinel among the first bytes: the match would run on into another string
        closed = np.where(self.text == 0, np.arange(self.n + 1), self.n)
        end = np.minimum.accumulate(closed[::-1])[::-1]
        return hit & (end - np.arange(self.n + 1) >= self.depth)


def repeated_starts(strings: list[np.ndarray], depth: int, folder: str, memory: int = 200_000) -> list[np.ndarray]:
    """For each string, the starts of `depth`-byte strings that also start elsewhere in the shard."""
    if not strings:
        return []
    if depth > 254:
        raise ValueError("common prefixes are kept in a byte: depth may be 254 at most")
    shard = Shard(strings, folder, memory, depth)
    hit = shard.repeated()
    return [np.flatnonzero(hit[s : s + len(x)]) for s, x in zip(shard.start, strings, strict=True)]

