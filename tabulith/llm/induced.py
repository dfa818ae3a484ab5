"""External induced sorting of suffixes, with their common-prefix values.

The text is a run of strings, each closed by symbol 0. Suffixes are split into types
L and S by their first unequal neighbour. The leftmost S suffixes (S*) are sorted by
induction on their substrings, which names them; the shorter text of names is sorted
in turn (by doubling: names are many, so buckets per name would hold one each). Then
two scans induce everything else: each reads sorted suffixes and appends the suffix
one symbol to the left to the queue of its first symbol. A queue entry is the tuple
(position, common prefix with the entry before it); the common prefix of two induced
entries is one more than the least common prefix between the entries that induced
them. Prefixes are counted up to ``cap`` symbols; beyond it order is not needed.

The queues, one per symbol and drained in symbol order, are the priority queue.
Together they keep ``budget`` entries in memory and the rest in an unnamed scratch
file of the task, which is gone with the task, so a shard may be larger than memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

SYMBOLS = 257
#: Entries read from a queue, and so worked on, at once.
STEP = 1 << 20
#: Queue entries of a shard kept in memory.
BUDGET = 8 << 20
_ENTRY = np.dtype([("at", "<i8"), ("common", "u1")])


class Queues:
    """First-in first-out queues per symbol; blocks beyond the budget go to disk."""

    def __init__(self, budget: int):
        self.budget, self.held, self.file = budget, 0, None
        self.blocks: list[list] = [[] for _ in range(SYMBOLS)]

    def put(self, symbol: int, at: np.ndarray, common: np.ndarray) -> None:
        if self.held + len(at) > self.budget:
            block = np.empty(len(at), _ENTRY)
            block["at"], block["common"] = at, common
            self.file = self.file or tempfile.TemporaryFile()
            place = self.file.seek(0, 2)
            self.file.write(block.tobytes())
            self.blocks[symbol].append((place, len(at)))
        else:
            self.held += len(at)
            self.blocks[symbol].append((at, common))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest blocks of a queue, up to STEP entries."""
        if not self.blocks[symbol]:
            return None
        out, n = [], 0
        while self.blocks[symbol] and n < STEP:
            a, b = self.blocks[symbol].pop(0)
            if isinstance(a, np.ndarray):
                self.held -= len(a)
            else:
                self.file.seek(a)
                block = np.frombuffer(self.file.read(b * _ENTRY.itemsize), _ENTRY)
                a, b = block["at"], block["common"]
            out.append((a, b))
            n += len(a)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def range_least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of ``values[left..right]`` (both ends in), for many ranges at once."""
    out = np.zeros(len(left), values.dtype)
    level = np.log2(right - left + 1).astype(np.int64)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[left[mine]], table[right[mine] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


class Scan:
    """One inducing scan: what was read from a symbol's bucket appends to the queues of other symbols."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int, budget: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queues = Queues(budget)
        self.source = np.full(SYMBOLS, -1, np.int64)
        self.carry = np.full(SYMBOLS, 255, np.uint8)

    def feed(self, symbol: int, at: np.ndarray, common: np.ndarray) -> None:
        """Read sorted suffixes of ``symbol``; ``common[i]`` belongs to entries i - 1 and i."""
        here = self.source == symbol
        chosen = np.flatnonzero((at > 0) & self.wanted[at - 1])
        if len(chosen):
            first = self.text[at[chosen] - 1]
            order = np.argsort(first, kind="stable")
            chosen, first = chosen[order], first[order].astype(np.int64)
            left = np.empty(len(chosen), np.int64)
            left[0], left[1:] = 0, chosen[:-1] + 1
            head = np.concatenate([[True], first[1:] != first[:-1]])
            left[head] = 0
            least = range_least(common, left, chosen)
            heads = first[head]
            # The first of a queue's new entries looks back to what the same bucket sent it before.
            since = np.where(here[heads], np.minimum(self.carry[heads], least[head]), 0)
            least[head] = since
            value = np.minimum(least.astype(np.int64) + 1, self.cap).astype(np.uint8)
            empty = self.source[heads] < 0
            value[np.flatnonzero(head)[empty]] = 0
            cuts = np.append(np.flatnonzero(head), len(chosen))
            for s, a, b in zip(heads.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.queues.put(s, at[chosen[a:b]] - 1, value[a:b])
            last = chosen[cuts[1:] - 1]
        self.carry[here] = np.minimum(self.carry[here], common.min(initial=255))
        if len(chosen):
            rest = np.full(len(heads), 255, np.uint8)
            more = last + 1 < len(common)
            rest[more] = range_least(common, last[more] + 1, np.full(more.sum(), len(common) - 1))
            self.carry[heads] = rest
            self.source[heads] = symbol


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position: is its suffix of type S, and how often does its symbol repeat from there."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1
    lengths = np.diff(np.concatenate([[0], ends]))
    after = np.append(text[ends[:-1]], 0) if n else text
    smaller = np.repeat(text[ends - 1] < after, lengths) | (text == 0)
    kind = _places(n)
    return smaller, np.repeat(ends.astype(kind), lengths) - np.arange(n, dtype=kind)


def _places(n: int) -> type:
    """The type of places in a text of ``n`` symbols: four bytes where they do."""
    return np.int32 if n < 1 << 31 else np.int64


def _induce(text, is_s, runs, seeds, seed_common, cap, budget, cut):
    """All suffixes in order with common prefixes, from S* suffixes in order.

    ``cut``: the seeds stand for their first symbol only (sorting of S* substrings).
    """
    lower = Scan(text, ~is_s, cap, budget)
    starts = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))
    l_parts: list[list] = [[] for _ in range(SYMBOLS)]
    for c in range(SYMBOLS):
        last = -1
        while (block := lower.queues.take(c)) is not None:
            l_parts[c].append(block)
            last = int(block[0][-1])
            lower.feed(c, *block)
        at, common = seeds[starts[c] : starts[c + 1]], seed_common[starts[c] : starts[c + 1]].copy()
        if len(at):
            common[0] = 0 if last < 0 else min(int(runs[last]), 1 if cut else int(runs[at[0]]), cap)
            for i in range(0, len(at), STEP):
                lower.feed(c, at[i : i + STEP], common[i : i + STEP])
    upper = Scan(text, is_s & (text > 0), cap, budget)
    out_at, out_common = [], []
    for c in range(SYMBOLS - 1, 0, -1):
        s_part, last = [], -1
        while (block := upper.queues.take(c)) is not None:
            s_part.append(block)
            last = int(block[0][-1])
            upper.feed(c, *block)
        l_at = np.concatenate([a for a, _ in l_parts[c]]) if l_parts[c] else np.zeros(0, np.int64)
        l_common = np.concatenate([b for _, b in l_parts[c]]) if l_parts[c] else np.zeros(0, np.uint8)
        meet = min(int(runs[last]), int(runs[l_at[-1]]), cap) if last >= 0 and len(l_at) else 0
        if len(l_at):
            down = np.append(np.uint8(meet), l_common[:0:-1])
            for i in range(0, len(l_at), STEP):
                upper.feed(c, l_at[::-1][i : i + STEP], down[i : i + STEP])
        if s_part:
            s_at, s_down = np.concatenate([a for a, _ in s_part])[::-1], np.concatenate([b for _, b in s_part])
            out_at.append(s_at)
            out_common.append(np.append(np.uint8(meet), s_down[:0:-1]))
        if len(l_at):
            out_at.append(l_at)
            l_common[0] = 0
            out_common.append(l_common)
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(out_at[::-1]), np.concatenate(out_common[::-1])


def _names_in_order(names: np.ndarray, last: np.ndarray, cap: int) -> np.ndarray:
    """Ranks of the suffixes of the text of names: doubling, each string ending at ``last``."""
    n, reach = len(names), last - np.arange(len(names))
    rank, step = names.astype(np.int64), 1
    while step < cap:
        ahead = np.where(reach >= step, rank[np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        distinct, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        step *= 2
        if len(distinct) == n:
            break
    return rank


def common_prefix(raw: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal bytes from ``a`` and from ``b`` on, up to the end of their strings and ``cap``."""
    padded = np.concatenate([raw, np.zeros(cap + 16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    for j in range(0, cap, 8):
        diff = eight[a[active] + j] ^ eight[b[active] + j]
        whole = diff == 0
        low = diff[~whole]
        bit = (low & (~low + np.uint64(1))).astype(np.float64)
        out[active[~whole]] = j + (np.log2(bit).astype(np.int64) >> 3)
        active = active[whole]
        if not len(active):
            break
    out[active] = cap
    return np.minimum(np.minimum(out, cap), np.minimum(end[a] - a, end[b] - b))


def sorted_suffixes(data: np.ndarray, at: np.ndarray, cap: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the byte strings ``data[at[i]:at[i + 1]]`` (none empty), sorted by their first ``cap`` bytes.

    Returns for every suffix in order: its string, its place in it, and how many bytes
    it shares with the suffix before it.
    """
    n = len(at) - 1
    kind = _places(len(data) + n)
    place = np.arange(len(data), dtype=kind) + np.repeat(np.arange(n, dtype=kind), np.diff(at))
    text = np.zeros(len(data) + n, np.uint16)
    text[place] = data.astype(np.uint16) + 1
    is_s, runs = _runs(text)
    star = is_s.copy()
    star[1:] &= ~is_s[:-1]
    star[:1] = text[:1] == 0
    stars = np.flatnonzero(star).astype(kind)
    ends = np.flatnonzero(text == 0)

    seeds = stars[np.argsort(text[stars], kind="stable")]
    same = np.zeros(len(seeds), np.uint8)
    same[1:] = text[seeds[1:]] == text[seeds[:-1]]
    order, common = _induce(text, is_s, runs, seeds, same, cap, budget, cut=True)

    string_of = np.repeat(np.arange(n, dtype=kind), np.diff(at) + 1)
    # Names of the S* substrings: a new one where the common prefix is shorter than the substring.
    length = np.zeros(len(text), kind)
    length[stars[:-1]] = np.diff(stars) + 1
    length[ends] = 1
    is_star = star[order]
    where = np.flatnonzero(is_star)
    ranked = order[where]
    names = np.zeros(len(text), kind)
    if len(where):
        least = np.append(0, range_least(common, where[:-1] + 1, where[1:])) if len(where) > 1 else np.zeros(1, np.int64)
        size = np.minimum(length[ranked], cap)
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = (least[1:] < size[1:]) | (size[1:] != size[:-1])
        names[ranked] = np.cumsum(fresh)
    reduced = names[stars]  # string ends have name 0
    del order, common, length, names, is_star, where, ranked, star
    last = np.searchsorted(stars, ends)[string_of[stars]]
    rank = _names_in_order(reduced, last, cap)
    seeds = stars[np.argsort(rank, kind="stable")]
    del rank, reduced, last, stars

    raw = np.zeros(len(text), np.uint8)
    raw[place] = data
    end_of = ends.astype(kind)[string_of]
    known = np.zeros(len(seeds), np.uint8)
    known[1:] = common_prefix(raw, end_of, seeds[:-1], seeds[1:], cap)
    # Ends of strings are equal symbols of one bucket.
    known[1:][(text[seeds[1:]] == 0) & (text[seeds[:-1]] == 0)] = 1
    del raw, end_of, place
    order, common = _induce(text, is_s, runs, seeds, known, cap, budget, cut=False)
    del text, is_s, runs, seeds, known
    owner = string_of[order]
    left = ends[owner] - order
    common[1:] = np.minimum(common[1:], np.minimum(left[1:], left[:-1]))  # an end equals another end
    starts = at[:-1] + np.arange(n)
    return owner, order - starts[owner], common
