"""External induced suffix sorting with common-prefix values.

Suffixes of type S whose predecessor is of type L (LMS) are sorted through a reduced
string, by recursion; all others are induced from them: each suffix, once its place is
known, sends its predecessor as a tuple (position, common prefix) to a priority queue
keyed by the predecessor's symbol. Within a symbol tuples arrive in sorted order, so that
the queue is a first-in-first-out run for each symbol, and runs beyond a memory bound go
to disk. The common prefix of two tuples that follow each other in a run is one more than
the least common prefix between the suffixes that sent them.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Tuples that are handled at once, bytes of queued tuples held in memory.
BLOCK, MEMORY = 1 << 16, 16 << 20
#: A reduced string up to this long ends the recursion: it is sorted in memory (some 40 bytes a symbol).
BASE = 1 << 21
#: With so many symbols at most each has a queue of its own.
FEW_SYMBOLS = 256


def _joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return blocks[0] if len(blocks) == 1 else (np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]))


class RunQueue:
    """A first-in-first-out run of tuples (position, common prefix) for each symbol, spilled to one file when large."""

    def __init__(self, memory: int, folder: str | None):
        self.memory, self.held = memory, 0
        self.runs: dict[int, list] = defaultdict(list)
        self.file = tempfile.TemporaryFile(dir=folder)

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(0, 2)
        for blocks in self.runs.values():
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    blocks[i] = (self.file.tell(), len(block[0]), block[0].dtype, len(block[1]))
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The run in order, in blocks of about BLOCK tuples."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for block in self.runs.pop(symbol, []):
            if isinstance(block[0], np.ndarray):
                self.held -= block[0].nbytes + block[1].nbytes
            else:
                offset, n, kind, lcps = block
                self.file.seek(offset)
                block = np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(lcps), np.uint8)
            held.append(block)
            size += len(block[0])
            if size >= BLOCK:
                yield _joined(held)
                held, size = [], 0
        if held:
            yield _joined(held)

    def close(self) -> None:
        self.file.close()


def _stable(key: np.ndarray) -> np.ndarray:
    """The stable order of non-negative whole numbers: packed with their places where both fit, since plain numbers sort much faster."""
    n = len(key)
    bits = max(1, n - 1).bit_length()
    if not n or int(key.max()) >> (62 - bits):
        return np.argsort(key, kind="stable")
    packed = (key.astype(np.int64) << bits) | np.arange(n)
    packed.sort()
    return packed & ((1 << bits) - 1)


def _order_of(key: np.ndarray) -> np.ndarray:
    """An order of non-negative whole numbers, equal ones in any."""
    n = len(key)
    bits = max(1, n - 1).bit_length()
    if n and int(key.max()) >> (62 - bits):
        return np.argsort(key)
    return _stable(key)


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S: smaller than the next one. The end counts as smallest."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # last place of each run of equal symbols
        up = np.zeros(len(ends), bool)
        up[:-1] = t[ends[:-1]] < t[ends[:-1] + 1]
        s = np.repeat(up, np.diff(np.concatenate([[-1], ends])))
    return s


def _compare(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b, up to cap; t has cap + 8 bytes after its end, which equal nothing else there."""
    out, live, step = np.full(len(a), cap, np.int64), np.arange(len(a)), np.arange(8)
    for off in range(0, cap, 8):
        same = t[(a[live] + off)[:, None] + step] == t[(b[live] + off)[:, None] + step]
        broken = ~same.all(1)
        out[live[broken]] = np.minimum(cap, off + np.argmin(same[broken], 1))
        live = live[~broken]
        if not len(live):
            break
    return out.astype(np.uint8)


def _common(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and at b of a text of n bytes, up to cap.

    words holds the eight bytes from each place on, the first of them lowest, and reaches
    cap places past the end.
    """
    out, live = np.minimum(n - np.maximum(a, b), cap), np.arange(len(a))
    for off in range(0, cap, 8):
        x = words[a + off] ^ words[b + off]
        broken = x != 0
        x = x[broken]
        # The lowest bit that differs alone has an exact logarithm.
        at = off + ((np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1) >> 3)
        gone = live[broken]
        out[gone] = np.minimum(out[gone], at)
        on = ~broken
        live, a, b = live[on], a[on], b[on]
        if not len(live):
            break
    return out.astype(np.uint8)


class _Sender:
    """Sends predecessors to a queue and keeps, for each symbol, the least common prefix since its last tuple."""

    def __init__(self, t: np.ndarray, symbols: int, queue: RunQueue, cap: int, carry: bool):
        self.t, self.queue, self.cap, self.carry = t, queue, cap, carry
        self.least = np.zeros(symbols, np.uint8) if carry else None

    def send(self, at: np.ndarray, lcp: np.ndarray, symbol: int, larger: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sends on what precedes the suffixes at, whose symbol this is, in their order.

        lcp holds the common prefix of each with the one before it. Predecessors with a
        larger symbol (or smaller, as asked) go to the queue; those with the same symbol
        are returned with their common prefixes.
        """
        keep: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(at), BLOCK):
            self._block(at[i : i + BLOCK], lcp[i : i + BLOCK] if self.carry else lcp, symbol, larger, keep)
        return _joined(keep) if keep else (at[:0], lcp[:0])

    def _block(self, at: np.ndarray, lcp: np.ndarray, symbol: int, larger: bool, keep: list) -> None:
        before = at - 1
        p = self.t[before]  # before the first position stands the last byte of the padding; masked next
        fits = (p >= symbol) if larger else (p <= symbol)
        fits &= at > 0
        chosen = np.flatnonzero(fits)
        if not len(chosen):
            if self.carry:
                np.minimum(self.least, lcp.min(), out=self.least)
            return
        p = p[chosen]
        order = np.argsort(p, kind="stable")
        p, chosen = p[order], chosen[order]
        cut = np.flatnonzero(p[1:] != p[:-1]) + 1
        first = np.concatenate([[0], cut]).astype(np.int64)
        where = before[chosen]
        if self.carry:
            common = self._carried(lcp, p, chosen, first)
        for a, b in zip(first, [*cut, len(p)]):
            q, block = int(p[a]), (where[a:b], common[a:b] if self.carry else lcp[:0])
            if q == symbol:
                keep.append(block)
            else:
                self.queue.push(q, *block)

    def _carried(self, lcp: np.ndarray, p: np.ndarray, chosen: np.ndarray, first: np.ndarray) -> np.ndarray:
        m = len(lcp)
        levels = [lcp]
        while (1 << len(levels)) <= m:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        start = np.empty(len(chosen), np.int64)
        start[1:] = chosen[:-1] + 1
        start[first] = 0
        k = np.frexp((chosen - start + 1).astype(np.float64))[1] - 1
        low = np.empty(len(chosen), np.uint8)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = levels[level]
            low[at] = np.minimum(row[start[at]], row[chosen[at] - (1 << int(level)) + 1])
        symbols = p[first]
        low[first] = np.minimum(low[first], self.least[symbols])
        # the least since the last tuple of each symbol, for the next block
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap).astype(np.uint8)
        ends = chosen[np.append(first[1:], len(chosen)) - 1]
        self.least = np.minimum(self.least, tail[0])
        self.least[symbols] = tail[ends + 1]
        return np.minimum(low.astype(np.int64) + 1, self.cap).astype(np.uint8)


def _scratch(n: int, kind: type, memory: int, folder: str | None) -> np.ndarray:
    """An array of zeros; a large one is a mapping of an unlinked file."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(dir=folder) as f:
        return np.memmap(f, kind, "w+", shape=(n,))


def _cut(at: np.ndarray, lcp: np.ndarray, step: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(at), step):
        yield at[i : i + step], lcp[i : i + step]


def _waves(sender: _Sender, blocks: Iterator, c: int, larger: bool, cap: int, keep) -> None:
    """Passes the tuples of symbol c to keep, in order: those of the queue, then what precedes them with the same symbol, and so on."""
    depth = 0
    while True:
        after: list[tuple[np.ndarray, np.ndarray]] = []
        first = True
        for at, lcp in blocks:
            if first and sender.carry:
                lcp = lcp.copy()
                lcp[0] = min(cap, depth)  # what stands before it starts with one symbol less of this kind
            first = False
            keep(at, lcp)
            same = sender.send(at, lcp, c, larger)
            if len(same[0]):
                after.append(same)
        if not after:
            return
        blocks, depth = iter(after), depth + 1


def _induce(t: np.ndarray, n: int, symbols: int, lms: np.ndarray, lms_lcp: np.ndarray, cap: int, carry: bool, memory: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and their common prefixes, from the LMS suffixes in order. t is padded.

    What is held at once is a block of tuples; queues and results beyond the memory bound are files.
    """
    small = np.int32 if n < 2**31 else np.int64
    none = np.zeros(0, np.uint8)
    first = t[lms]
    starts = np.searchsorted(first, np.arange(symbols + 1)) if symbols <= 1 << 16 else None
    present = np.unique(t[:n])
    low_at, low_lcp = _scratch(n, small, memory, folder), _scratch(n if carry else 0, np.uint8, memory, folder)
    bounds: dict[int, tuple[int, int]] = {}
    filled = 0

    def keep_low(at: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal filled
        low_at[filled : filled + len(at)] = at
        if carry:
            low_lcp[filled : filled + len(at)] = lcp
        filled += len(at)

    queue = RunQueue(memory, folder)
    sender = _Sender(t, symbols, queue, cap, carry)
    queue.push(int(t[n - 1]), np.array([n - 1], small), np.zeros(1, np.uint8) if carry else none)
    for c in map(int, present):
        begin = filled
        _waves(sender, queue.pop(c), c, True, cap, keep_low)
        bounds[c] = (begin, filled)
        a, b = (starts[c], starts[c + 1]) if starts is not None else np.searchsorted(first, [c, c + 1])
        if b > a:
            head = int(_compare(t, low_at[filled - 1 : filled].astype(np.int64), lms[a : a + 1], cap)[0]) if carry and filled > begin else 0
            for at, lcp in _cut(lms[a:b], lms_lcp[a:b] if carry else none):
                if carry and at[0] == lms[a]:
                    lcp = lcp.copy()
                    lcp[0] = head
                sender.send(at.astype(small), lcp, c, True)
    queue.close()

    out_at, out_lcp = _scratch(n, small, memory, folder), _scratch(n if carry else 0, np.uint8, memory, folder)
    top = n

    def keep_high(at: np.ndarray, lcp: np.ndarray) -> None:
        """Writes downwards; lcp compares with the suffix above, which is where it is stored."""
        nonlocal top
        out_at[top - len(at) : top] = at[::-1]
        if carry:
            stored = lcp[::-1]
            if top < n:
                out_lcp[top] = lcp[0]
            out_lcp[top - len(at) + 1 : top] = stored[:-1]
        top -= len(at)

    queue = RunQueue(memory, folder)
    sender = _Sender(t, symbols, queue, cap, carry)
    for c in map(int, present[::-1]):
        was = top
        if carry and top < n:
            out_lcp[top] = 0  # another symbol below
        _waves(sender, queue.pop(c), c, False, cap, keep_high)
        if carry and was < n and top < was:
            out_lcp[was] = 0
        begin, end = bounds[c]
        if end > begin:
            seam = 0
            if carry and top < was:
                seam = int(_compare(t, out_at[top : top + 1].astype(np.int64), low_at[end - 1 : end].astype(np.int64), cap)[0])
                out_lcp[top] = seam
            for stop in range(end, begin, -BLOCK):
                start = max(begin, stop - BLOCK)
                lcp = none
                if carry:
                    lcp = np.empty(stop - start, np.uint8)
                    lcp[0] = seam if stop == end else low_lcp[stop]
                    lcp[1:] = low_lcp[start + 1 : stop][::-1]
                sender.send(low_at[start:stop][::-1], lcp, c, False)
            size = end - begin
            out_at[top - size : top] = low_at[begin:end]
            if carry:
                out_lcp[top - size : top] = low_lcp[begin:end]
            top -= size
    queue.close()
    return out_at, out_lcp


class _Ranges:
    """Symbols in ranges of about BLOCK suffixes each; a symbol with more of them has a range of its own."""

    def __init__(self, t: np.ndarray, n: int, symbols: int):
        upto = np.zeros(symbols + 1, np.int64)
        for at in range(0, n, BLOCK):
            upto[1:] += np.bincount(t[at : at + BLOCK][: n - at], minlength=symbols)[:symbols]
        np.cumsum(upto, out=upto)
        starts, at = [0], 0
        while upto[at] < n:
            at = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
            starts.append(at)
        self.edges = np.array(starts)
        self.of = np.searchsorted(self.edges, np.arange(symbols), "right").astype(np.int32) - 1

    def __len__(self) -> int:
        return len(self.edges) - 1


def _in_range_order(symbol: np.ndarray, kind: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a range of symbols.

    Within a symbol come first the suffixes that a queue held, in their order (kind 0), then
    those that precede others of the range (kind 1; follow names the other), in the order
    of those, then the ones whose order is known from before (kind 2). Ranks of single
    suffixes are extended along the chains, by doubling.
    """
    n, key, follow = len(symbol), 3 * (symbol - symbol.min()) + kind, follow.copy()
    order = _stable(key)
    fresh = (key[order[1:]] != key[order[:-1]]) | (kind[order[1:]] != 1)  # only those of kind 1 have equals
    while not fresh.all():
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(fresh)])
        key = rank * n + rank[follow]
        follow = follow[follow]
        order = _stable(key)
        fresh = key[order[1:]] != key[order[:-1]]
    return order


def _phase(t: np.ndarray, ranges: _Ranges, queue: RunQueue, known, keep, down: bool) -> None:
    """One direction of the induction, a range of symbols at a time; known(r) gives the suffixes of a range whose order is known, keep(at) takes those that are found, in order.

    Upwards it finds suffixes of type L, downwards those of type S; queues are read and
    written in the direction of the phase.
    """
    sign = -1 if down else 1
    for r in range(len(ranges) - 1, -1, -1) if down else range(len(ranges)):
        blocks = [at for at, _ in queue.pop(r)]
        seeds = np.concatenate(blocks).astype(np.int64) if blocks else np.zeros(0, np.int64)
        given = known(r)
        at, kinds, follow = [seeds, given], [np.zeros(len(seeds), np.int8), np.full(len(given), 2, np.int8)], [np.arange(len(seeds) + len(given))]
        wave, wave_at, size = np.concatenate([seeds, given]), np.arange(len(seeds) + len(given)), len(seeds) + len(given)
        first = True
        while len(wave):
            before = wave - 1
            p, q = t[before], t[wave]
            fits = (wave > 0) & (ranges.of[np.minimum(p, len(ranges.of) - 1)] == r) & ((p <= q) if down else (p >= q))
            if first:  # what is given is of the other type: its like-symboled predecessor is so too
                fits[len(seeds) :] &= p[len(seeds) :] != q[len(seeds) :]
                first = False
            wave, parent = before[fits], wave_at[fits]
            wave_at = np.arange(size, size + len(wave))
            size += len(wave)
            at.append(wave)
            kinds.append(np.ones(len(wave), np.int8))
            follow.append(parent)
        if not size:
            continue
        at, kinds = np.concatenate(at), np.concatenate(kinds)
        order = _in_range_order(sign * t[at].astype(np.int64), kinds, np.concatenate(follow))
        at, kinds = at[order], kinds[order]
        keep(r, at[kinds != 2])
        before = at - 1
        p = t[before]
        out = (at > 0) & ((p < t[at]) if down else (p > t[at]))
        where = ranges.of[np.minimum(p, len(ranges.of) - 1)]
        out &= (where < r) if down else (where > r)
        before, where = before[out], where[out]
        order = _stable(where)
        before, where = before[order], where[order]
        cut = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]])
        for x, y in zip(cut, cut[1:]):
            if y > x:
                queue.push(int(where[x]), before[x:y].astype(queue.kind), queue.none)


def _induce_names(t: np.ndarray, n: int, symbols: int, lms: np.ndarray, memory: int, folder: str | None) -> np.ndarray:
    """All suffixes of a string of names in order, from the LMS suffixes in order (sorted by their symbols at least).

    Names are many and each has few suffixes, so that the queues are for ranges of names
    and a range is put in order at once. What is held is a range, the rest are files.
    """
    small, none = np.int32 if n < 2**31 else np.int64, np.zeros(0, np.uint8)
    ranges = _Ranges(t, n, symbols)
    given = np.searchsorted(ranges.of[t[lms]], np.arange(len(ranges) + 1))
    low, bounds, filled = _scratch(n, small, memory, folder), {}, 0

    def keep_low(r: int, at: np.ndarray) -> None:
        nonlocal filled
        low[filled : filled + len(at)] = at
        bounds[r] = (filled, filled + len(at))
        filled += len(at)

    def queue() -> RunQueue:
        q = RunQueue(memory, folder)
        q.kind, q.none = small, none
        return q

    upward = queue()
    upward.push(int(ranges.of[t[n - 1]]), np.array([n - 1], small), none)
    _phase(t, ranges, upward, lambda r: lms[given[r] : given[r + 1]].astype(np.int64), keep_low, False)
    upward.close()
    out, top = _scratch(n, small, memory, folder), n

    def lows(r: int) -> np.ndarray:
        a, b = bounds.get(r, (0, 0))
        return low[a:b][::-1].astype(np.int64)

    def keep_high(r: int, at: np.ndarray) -> None:
        """Lays a range's suffixes out downwards: within a symbol those of type S stand above those of type L."""
        nonlocal top
        a, b = bounds.get(r, (0, 0))
        both = np.concatenate([at[::-1], low[a:b]])
        kind = np.concatenate([np.ones(len(at), np.int8), np.zeros(b - a, np.int8)])
        out[top - len(both) : top] = both[np.lexsort((kind, t[both]))]
        top -= len(both)

    downward = queue()
    _phase(t, ranges, downward, lows, keep_high, True)
    downward.close()
    return out


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of names by their first depth symbols at least.

    A rank is the place of the first of those that are alike so far; only those that are
    not alone in their rank are sorted again.
    """
    n, k = len(names), 1
    size = np.bincount(names)
    rank = (np.cumsum(size) - size)[names]
    live = np.flatnonzero(size[names] > 1)
    while k < depth and k < n and len(live):
        was, ahead = rank[live], live + k
        key = was * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = _order_of(key)
        live, key, was = live[order], key[order], was[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(np.concatenate([[True], was[1:] != was[:-1]]))
        first = np.flatnonzero(new)
        alike = np.diff(np.append(first, len(key)))
        rank[live] = was + np.repeat(first, alike) - np.repeat(head, np.diff(np.append(head, len(key))))
        live = live[np.repeat(alike > 1, alike)]
        k *= 2
    return _stable(rank)


def _names(t: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings that start at order and have these lengths, equal ones alike; t is padded with symbols beyond all."""
    a, b, la, lb = order[:-1], order[1:], length[:-1], length[1:]
    same = la == lb
    live, off = np.flatnonzero(same), 0
    while len(live):
        differ = t[a[live] + off] != t[b[live] + off]
        same[live[differ]] = False
        off += 1
        live = live[~differ & (la[live] > off)]
    return np.concatenate([[0], np.cumsum(~same)])


def _order(t: np.ndarray, n: int, symbols: int, lms: np.ndarray, cap: int, memory: int, folder: str | None) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order, without common prefixes."""
    if symbols <= FEW_SYMBOLS:
        return _induce(t, n, symbols, lms, np.zeros(0, np.uint8), cap, False, memory, folder)[0]
    return _induce_names(t, n, symbols, lms, memory, folder)


def _sorted_lms(t: np.ndarray, n: int, symbols: int, cap: int, memory: int, base: int, folder: str | None) -> np.ndarray:
    """The LMS suffixes in the order of their first cap symbols at least."""
    s = _types(t[:n])
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) < 2:
        return lms
    # A first induction sorts the LMS substrings, whatever the order within a symbol.
    rough = _order(t, n, symbols, lms[_stable(t[lms])], cap, memory, folder)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = np.concatenate([at[is_lms[at]] for at, _ in _cut(rough, rough)]).astype(np.int64)
    del s, rough, is_lms
    span = _scratch(n, np.int32 if n < 2**31 - 1 else np.int64, memory, folder)
    span[lms[:-1]] = np.diff(lms) + 1
    span[lms[-1]] = n - lms[-1] + 1  # with the end of the text
    names = _scratch(n, np.int32 if n < 2**31 else np.int64, memory, folder)
    names[order] = _names(t, order, span[order])
    reduced = names[lms]
    del order, span, names
    if len(reduced) <= base:
        return lms[_doubled(reduced, -(-cap // 2) + 1)]
    kinds = int(reduced.max()) + 1
    padded = np.concatenate([reduced, np.full(cap + 8, kinds, np.int64)])
    depth = -(-cap // 2) + 1
    inner = _sorted_lms(padded, len(reduced), kinds + 1, depth, memory, base, folder)
    return lms[_order(padded, len(reduced), kinds + 1, inner, depth, memory, folder)]


def _sorted(t: np.ndarray, n: int, symbols: int, cap: int, memory: int, base: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    lms = _sorted_lms(t, n, symbols, cap, memory, base, folder)
    raw = np.zeros(n + cap + 16, np.uint8)
    raw[:n] = t[:n]
    words = np.ndarray((n + cap + 8,), "<u8", raw, strides=(1,))
    common = np.zeros(len(lms), np.uint8)
    for i in range(1, len(lms), BLOCK):
        common[i : i + BLOCK] = _common(words, n, lms[i - 1 : i - 1 + len(lms[i : i + BLOCK])], lms[i : i + BLOCK], cap)
    del raw, words
    return _induce(t, n, symbols, lms, common, cap, True, memory, folder)


def suffix_array(text: bytes, cap: int = 50, memory: int = MEMORY, base: int = BASE, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first cap bytes, and common prefixes with the one before, up to cap.

    The byte 255, which UTF-8 never has, has to end every stretch that is to be matched
    alone: such bytes equal each other here, so that a caller ignores suffixes that reach
    one within cap bytes. cap is 200 at most.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    t = _scratch(n + cap + 9, np.uint16, memory, folder)
    t[:n] = np.frombuffer(text, np.uint8)
    t[n:] = np.arange(256, 256 + cap + 9)  # past the end, equal to nothing
    return _sorted(t, n, 256, cap, memory, base, folder)
