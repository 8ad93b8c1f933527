"""Suffix order and common prefixes by induced sorting in external memory.

A suffix is S if it is smaller than the next one, L if it is larger; an LMS suffix is an S behind an L.
The LMS substrings are sorted by inducing from their first symbols, named, and the string of their names,
half the text or less, is sorted by recursion, or in memory once it fits there; the sorted LMS suffixes then induce all L suffixes
in ascending and, from these, all S suffixes in descending order.

What is induced waits in a priority queue of runs sorted by symbol.  Its rows are tuples of a symbol, a place
and the bytes that the suffix behind the place has in common with the one that was pushed for the same symbol
before; so the common prefix of two neighbours is known when they leave the queue.  Rows leave in blocks: as
many as come before anything that they push themselves.  Queue runs and all columns of a text's length
above ``MEMORY_BYTES`` are files in a folder of the task's own, gone with it; in memory are only blocks.

Common prefixes are counted in bytes up to a limit: suffixes that share so many are left in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
from pyspark.shuffle import _get_local_dirs

#: Columns above this size are files.
MEMORY_BYTES = 64 << 20
#: Rows of a queue's run that is not merged any more, rows that are looked at together, and symbols at once.
MOST_OF_RUN, BLOCK, CHUNK = 2_000_000, 262_144, 4_000_000
#: A string of names up to this length is sorted in memory, which ends the recursion.
BASE_NAMES = 4_000_000
FAR = np.iinfo(np.int64).max
OPEN = np.uint8(255)


class Scratch:
    """Columns in memory or, large ones, in files of a folder of Spark's local ones, deleted at the end."""

    def __init__(self, memory_bytes: int | None = None):
        self.most = MEMORY_BYTES if memory_bytes is None else memory_bytes
        self.folder, self.number = None, 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def column(self, n: int, kind) -> np.ndarray:
        """``n`` zeros."""
        if n * np.dtype(kind).itemsize <= self.most:
            return np.zeros(n, kind)
        if not self.folder:
            parent = _get_local_dirs("induced")[0]
            os.makedirs(parent, exist_ok=True)
            self.folder = tempfile.mkdtemp(dir=parent)
        self.number += 1
        path = f"{self.folder}/{self.number}"
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the file lasts as long as the column
        return out


def _stable(keys: np.ndarray) -> np.ndarray:
    """An order of keys, equal ones as they stand; small keys are sorted by digits."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


class Queue:
    """Rows (symbol, place, common) that leave by symbol, those of one symbol as they came."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.runs = scratch, []

    def push(self, symbol: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        order = _stable(symbol)
        self.runs.append([0, symbol[order], place[order], common[order]])
        while len(self.runs) > 1:
            (a, *one), (b, *two) = self.runs[-2:]
            left, right = len(one[0]) - a, len(two[0]) - b
            if left > 2 * right or left + right > MOST_OF_RUN:
                break
            both = [np.concatenate([x[a:], y[b:]]) for x, y in zip(one, two)]
            order = _stable(both[0])
            kept = [self.scratch.column(len(order), x.dtype) for x in both]
            for out, x in zip(kept, both):
                out[:] = x[order]
            self.runs[-2:] = [[0, *kept]]

    def first(self, most: int) -> tuple[list[np.ndarray], bool]:
        """The next rows with the number of their run, about ``most`` of each, and whether these are all."""
        self.runs = [r for r in self.runs if r[0] < len(r[1])]
        heads = [r[1][r[0] : r[0] + most] for r in self.runs]
        cut = [h[-1] for h, r in zip(heads, self.runs) if len(r[1]) - r[0] > most]
        upto = [len(h) for h in heads]
        if cut:
            bound = min(cut)
            upto = [int(np.searchsorted(h, bound)) for h in heads]
            if not any(upto):  # one symbol fills a head: its rows of the oldest run
                oldest = next(i for i, h in enumerate(heads) if h[0] == bound)
                upto = [int(np.searchsorted(h, bound, "right")) if i == oldest else 0 for i, h in enumerate(heads)]
        parts = [[r[k][r[0] : r[0] + n] for k in (1, 2, 3)] + [np.full(n, i, np.int16)] for i, (r, n) in enumerate(zip(self.runs, upto)) if n]
        if not parts:
            return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int16)], True
        if len(parts) == 1:
            return parts[0], not cut
        rows = [np.concatenate(x) for x in zip(*parts)]
        order = _stable(rows[0])
        return [x[order] for x in rows], not cut

    def drop(self, run: np.ndarray) -> None:
        """The rows with these numbers of runs have left."""
        for i, n in enumerate(np.bincount(run, minlength=len(self.runs))[: len(self.runs)]):
            self.runs[i][0] += int(n)


class Minima:
    """Least values of ranges of a sequence that grows."""

    def __init__(self):
        self.n, self.levels = 0, [np.zeros(1024, np.uint8)]

    def append(self, value: int) -> None:
        t = self.n
        if t == len(self.levels[0]):
            self.levels = [np.concatenate([x, np.zeros(len(x), np.uint8)]) for x in self.levels]
        while (1 << len(self.levels)) <= t + 1:
            self.levels.append(np.zeros(len(self.levels[0]), np.uint8))
        self.levels[0][t] = value
        for k in range(1, len(self.levels)):
            self.levels[k][t] = min(self.levels[k - 1][t], self.levels[k - 1][max(0, t - (1 << (k - 1)))])
        self.n += 1

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least values from ``first`` to ``last``, 255 for empty ranges."""
        out = np.full(len(first), OPEN)
        size = last - first + 1
        some = np.flatnonzero(size > 0)
        if len(some):
            k = (np.frexp(size[some])[1] - 1).astype(np.int64)
            table = np.stack(self.levels)
            out[some] = np.minimum(table[k, last[some]], table[k, first[some] + (1 << k) - 1])
        return out


def _between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values`` from ``first`` to ``last`` each, for ranges that aren't empty, by doubled strides."""
    k = (np.frexp(last - first + 1)[1] - 1).astype(np.int64)
    out, level = np.empty(len(first), np.uint8), values
    for step in range(int(k.max()) + 1 if len(k) else 0):
        if step:  # least of so many from each place on
            level = np.minimum(level[: -(1 << (step - 1))], level[1 << (step - 1) :])
        of = np.flatnonzero(k == step)
        out[of] = np.minimum(level[first[of]], level[last[of] - (1 << step) + 1])
    return out


class Ranges:
    """Least values of any ranges of a column: of blocks by a table, inside them from either end."""

    WIDE = 64

    def __init__(self, scratch: Scratch, values: np.ndarray):
        blocks = -(-len(values) // self.WIDE)
        self.values = scratch.column(blocks * self.WIDE, np.uint8)
        self.values[: len(values)] = values
        self.upto, self.onward = scratch.column(len(self.values), np.uint8), scratch.column(len(self.values), np.uint8)
        square = self.values.reshape(-1, self.WIDE)
        np.minimum.accumulate(square, 1, out=self.upto.reshape(-1, self.WIDE))
        self.onward.reshape(-1, self.WIDE)[:] = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1]
        self.table = [square.min(1)]
        while 1 << len(self.table) <= blocks:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least values from ``first`` to ``last`` each; no range may be empty."""
        a, b = first // self.WIDE, last // self.WIDE
        out = np.minimum(self.onward[first], self.upto[last])
        inside = np.flatnonzero(a == b)
        if len(inside):
            least = np.full(len(inside), OPEN)
            for d in range(int((last[inside] - first[inside]).max()) + 1):
                least = np.minimum(least, self.values[np.minimum(first[inside] + d, last[inside])])
            out[inside] = least
        some = np.flatnonzero(b - a > 1)
        if len(some):
            k = np.frexp(b[some] - a[some] - 1)[1] - 1
            for step in np.unique(k).tolist():
                of = some[k == step]
                out[of] = np.minimum(out[of], np.minimum(self.table[step][a[of] + 1], self.table[step][b[of] - (1 << step)]))
        return out


class Text:
    """Symbols of a string, the last of them 0 and the only one, with what the names stand for.

    ``weight``: bytes of each symbol; ``beside``: common bytes of a symbol and the one below it.
    """

    def __init__(self, scratch: Scratch, symbols: np.ndarray, weight: np.ndarray, beside: np.ndarray, limit: int):
        self.scratch, self.symbols, self.weight, self.limit = scratch, symbols, weight, limit
        self.beside = Ranges(scratch, beside)
        n = len(symbols)
        self.kind = np.int32 if n < 1 << 31 else np.int64  # of places
        self.small = scratch.column(n, bool)  # S
        self.run = scratch.column(n, np.uint8)  # how often the symbol stands from here on
        self.small[n - 1], self.run[n - 1] = True, 1
        for end in range(n - 1, 0, -CHUNK):
            begin = max(0, end - CHUNK)
            here, after = symbols[begin:end].astype(np.int64), symbols[begin + 1 : end + 1].astype(np.int64)
            at = np.where(here != after, np.arange(end - begin), end - begin)
            at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ
            rises = np.append(here < after, self.small[end])
            self.small[begin:end] = rises[at]
            repeats = at - np.arange(end - begin)
            # a run may go on in the next chunk
            repeats += np.where(at == end - begin, int(self.run[end]) if symbols[end - 1] == symbols[end] else 0, 1)
            self.run[begin:end] = np.minimum(repeats, limit)

        # a symbol with its type, looked up together
        self.code = scratch.column(n, np.int32)
        for begin in range(0, n, CHUNK):
            part = slice(begin, begin + CHUNK)
            self.code[part] = symbols[part].astype(np.int32) * 2 + self.small[part]
        self.plain = bool((weight == 1).all())

    def lms(self) -> np.ndarray:
        n, parts = len(self.symbols), []
        for begin in range(1, n, CHUNK):
            end = min(n, begin + CHUNK)
            parts.append((np.flatnonzero(self.small[begin:end] & ~self.small[begin - 1 : end - 1]) + begin).astype(self.kind))
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def induce(self, seeds: np.ndarray, commons: np.ndarray, ascending: bool, cut: bool = False):
        """Yields (places, commons, induced) of seeds and all that they induce, in order.

        ``commons``: bytes shared with the seed before, used for seeds of one symbol.  ``cut``: of a seed
        nothing is known but its symbol.
        """
        top = len(self.weight) - 1
        sign = (lambda s: s.astype(np.int64)) if ascending else (lambda s: top - s.astype(np.int64))
        queue, blocks = Queue(self.scratch), Minima()
        last_block = self.scratch.column(top + 1, np.int32)
        last_block -= 1
        tail = self.scratch.column(top + 1, np.uint8)
        at, size, before = 0, 1024, None
        while True:
            rows, all_rows = queue.first(size)
            some = seeds[at : at + size]
            seed_symbol = sign(self.symbols[some])
            if not len(some) and not len(rows[0]):
                return
            q = len(rows[0])
            if not all_rows:
                seed_symbol = seed_symbol[: int(np.searchsorted(seed_symbol, rows[0][-1]))]
            if at + size < len(seeds) and len(some):
                q = int(np.searchsorted(rows[0], sign(self.symbols[some[-1:]])[0], "right"))
            s = len(seed_symbol)
            if not s:
                symbol, place, common = (x[:q] for x in rows[:3])
                kind = np.zeros(q, np.int64)
            elif not q:
                symbol, place, common = seed_symbol, some[:s], commons[at : at + s]
                kind = np.ones(s, np.int64)
            else:
                symbol = np.concatenate([rows[0][:q], seed_symbol])
                kind = np.concatenate([np.zeros(q, np.int64), np.ones(s, np.int64)])
                order = _stable(2 * symbol + kind)
                symbol, kind = symbol[order], kind[order]
                place = np.concatenate([rows[1][:q], some[:s]])[order]
                common = np.concatenate([rows[2][:q], commons[at : at + s]])[order]
            # what is pushed, and how far rows come before all of it
            code = self.code[place - 1]
            pushes = (place > 0) & ((code & 1) != ascending)
            pushed = np.where(pushes, sign(code >> 1), FAR // 4)
            least = np.minimum.accumulate(2 * pushed)
            late = (2 * symbol + kind)[1:] > least[:-1]
            m = int(np.argmax(late)) + 1 if late.any() else len(symbol)
            symbol, kind, place, pushes, pushed = (x[:m] for x in (symbol, kind, place, pushes, pushed))
            queue.drop(rows[3][: int((kind == 0).sum())])
            at += int((kind == 1).sum())
            common = self._commons(symbol, kind, place, common[:m], before, top if not ascending else None, cut)
            before = symbol[-1], kind[-1], place[-1]
            yield place, common, kind == 0
            self._push(queue, blocks, last_block, tail, common, np.flatnonzero(pushes), pushed, place)
            size = min(BLOCK, max(1024, 2 * m))

    def _commons(self, symbol, kind, place, own, before, top, cut) -> np.ndarray:
        """Bytes that each row shares with the one before it."""
        s0 = np.concatenate([[before[0] if before else symbol[0]], symbol[:-1]])
        k0 = np.concatenate([[before[1] if before else 1], kind[:-1]])
        p0 = np.concatenate([[before[2] if before else place[0]], place[:-1]])
        real = symbol if top is None else top - symbol
        weight = 1 if self.plain else self.weight[real].astype(np.int64)
        out = np.where(kind == 0, np.minimum(weight + own.astype(np.int64), self.limit), own).astype(np.uint8)
        # a last L and a first S of one symbol: they differ behind the shorter run of it
        seam = np.flatnonzero((s0 == symbol) & (k0 == 0) & (kind == 1))
        if cut:
            out[seam] = np.minimum(self.weight[real[seam]], self.limit)
        elif len(seam):
            run = np.minimum(self.run[p0[seam]], self.run[place[seam]]).astype(np.int64)
            same = run * self.weight[real[seam]]
            short = np.flatnonzero(same < (0 if self.plain else self.limit))
            p, q = p0[seam[short]] + run[short], place[seam[short]] + run[short]
            same[short] += self._beside(self.symbols[p], self.symbols[q])
            out[seam] = np.minimum(same, self.limit)
        new = np.flatnonzero(s0 != symbol)
        if self.plain:
            out[new] = 0
        elif len(new):
            out[new] = self._beside(s0[new], symbol[new]) if top is None else self._beside(top - s0[new], real[new])
        if before is None:
            out[0] = 0
        return out

    def _beside(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Common bytes of different symbols."""
        low, high = np.minimum(one, other).astype(np.int64), np.maximum(one, other).astype(np.int64)
        return np.minimum(self.beside.of(low + 1, high), self.limit)

    def _push(self, queue, blocks, last_block, tail, common, at, pushed, place) -> None:
        """Rows for the queue with what they share with the row that was pushed for their symbol before."""
        if len(at):
            symbol = pushed[at]
            order = _stable(symbol)
            symbol, where = symbol[order], at[order]
            first = np.append(True, symbol[1:] != symbol[:-1])
            carried = np.zeros(len(at), np.uint8)
            again = np.flatnonzero(~first)
            carried[again] = _between(common, where[again - 1] + 1, where[again])
            name, begin = symbol[first], where[first]
            known = last_block[name]
            head = np.minimum.accumulate(common)[begin]
            least = np.minimum(np.minimum(tail[name], head), blocks.of(known + 1, np.full(len(name), blocks.n - 1)))
            carried[first] = np.where(known >= 0, least, 0)
            final = np.append(symbol[1:] != symbol[:-1], True)
            last_block[name] = blocks.n
            rest = np.append(np.minimum.accumulate(common[::-1])[::-1], OPEN)
            tail[name] = rest[where[final] + 1]
            back = np.empty(len(at), np.uint8)
            back[order] = carried
            queue.push(pushed[at].astype(np.int32), (place[at] - 1).astype(self.kind), back)
        blocks.append(int(common.min()))


def _kept(scratch: Scratch, blocks, wanted, n: int, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Of an order's blocks the wanted places, and what each shares with the one kept before it."""
    places, commons, size, open_ = scratch.column(n, kind), scratch.column(n, np.uint8), 0, OPEN
    for place, common, induced in blocks:
        at = np.flatnonzero(wanted(place, induced))
        if not len(at):
            open_ = min(open_, common.min())
            continue
        starts = np.append(0, at[:-1] + 1)
        least = np.minimum.reduceat(common[: at[-1] + 1], starts)
        least[0] = min(least[0], open_)
        places[size : size + len(at)] = place[at]
        commons[size : size + len(at)] = least
        size += len(at)
        open_ = common[at[-1] + 1 :].min() if at[-1] + 1 < len(common) else OPEN
    return places[:size], commons[:size]


def _backwards(places: np.ndarray, commons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order from its other end."""
    return places[::-1], np.append(OPEN, commons[1:][::-1])[: len(commons)]


def _from(text: Text, seeds: np.ndarray, commons: np.ndarray, cut: bool = False):
    """The whole descending order from the sorted LMS suffixes, as blocks; the last suffix is not among them."""
    n = len(text.symbols)
    larger = _kept(text.scratch, text.induce(seeds, commons, True, cut), lambda place, induced: induced, n, text.kind)
    return text.induce(*_backwards(*larger), False)


def sorted_suffixes(scratch: Scratch, symbols: np.ndarray, weight: np.ndarray, beside: np.ndarray, limit: int):
    """Blocks (places, commons, _) of all suffixes but the last one, in descending order."""
    text = Text(scratch, symbols, weight, beside, limit)
    lms = text.lms()
    if len(lms) < 2:  # the last suffix alone, and nothing falls before it but in one slope
        yield from _from(text, lms, np.zeros(len(lms), np.uint8))
        return
    names, heavy, between, commons, seeds = _named(text, lms)
    if names is None:
        pass
    elif len(lms) <= BASE_NAMES:
        up, commons = _doubled(names, heavy, limit)
        seeds = lms[up]
    else:
        down = _kept(scratch, sorted_suffixes(scratch, names, heavy, between, limit), lambda place, induced: place >= 0, len(lms))
        up, commons = _backwards(*down)
        seeds = np.append(lms[-1], lms[up])
        commons = np.append(OPEN, np.append(0, commons[1:]))[: len(seeds)]
    names = lms = None
    if text.plain:
        commons = _extended(text, seeds, commons)
    yield from _from(text, seeds, commons)


def _named(text: Text, lms: np.ndarray) -> tuple:
    """Names of the LMS substrings in the order of the text, with bytes of each name and those that it shares with the
    one below, and nothing more; or, if no name needs sorting, instead of names the commons and places of the sorted suffixes.

    All other columns of this step are gone when the names are sorted.
    """
    scratch, symbols, weight, limit = text.scratch, text.symbols, text.weight, text.limit
    n = len(symbols)
    seeds = lms[_stable(symbols[lms])]
    # LMS substrings end with the next LMS symbol: there, equal symbols are all that is known
    commons = np.minimum(weight[symbols[seeds]], limit).astype(np.uint8)
    is_lms = scratch.column(n, bool)
    is_lms[lms] = True
    places, shared = _backwards(*_kept(scratch, _from(text, seeds, commons, True), lambda place, induced: is_lms[place], len(lms), text.kind))
    seeds = commons = is_lms = None
    places, shared = np.append(lms[-1], places), np.append(OPEN, np.append(0, shared[1:]))[: len(places) + 1]
    ends = np.append(lms[1:], lms[-1:])  # the next LMS place
    if text.plain:
        length, last = ends - lms, 1  # without the last symbol
    else:
        bytes_to = np.append(0, np.cumsum(weight[symbols], dtype=np.int64))
        length, last = bytes_to[ends] - bytes_to[lms], weight[symbols[ends]]
        bytes_to = None
    rank_of = scratch.column(n, np.int32)
    rank_of[lms] = np.arange(len(lms), dtype=np.int32)
    k, rank_of = rank_of[places], None
    # beyond the limit nothing is compared, so that a byte more than it stands for all larger lengths
    whole = np.minimum(length + last, limit).astype(np.uint8)[k]
    alike = np.minimum(length, 1 << 30).astype(np.int32)[k]
    ends = length = last = None
    same = (shared[1:] >= whole[1:]) & (shared[1:] >= whole[:-1]) & ((alike[1:] == alike[:-1]) | (shared[1:] >= limit))
    first = np.append(True, ~same)
    name = (np.cumsum(first, dtype=np.int32) - 1).astype(np.int32)
    heavy = np.where(whole[first] >= limit, limit, np.minimum(alike[first], limit)).astype(np.uint8)
    heavy[0] = 1
    often = np.bincount(name, minlength=len(heavy)) > 1
    if (heavy[often] >= limit).all():  # every name is alone, or all that counts is the same
        return None, None, None, np.where(~first, limit, np.minimum(shared, limit)).astype(np.uint8), places
    between = shared[first].copy()
    between[0] = 0
    names = scratch.column(len(lms), np.int32)
    names[k] = name
    return names, heavy, between, None, None


def _doubled(names: np.ndarray, weight: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a string that fits in memory in ascending order, with bytes that neighbours share at least.

    Ranks by 1, 2, 4 names and so on, until ranks are apart or stand for ``limit`` bytes.
    """
    n, size = len(names), 1
    upto = np.append(0, np.cumsum(np.minimum(weight[names], limit).astype(np.int64)))
    upto, starts = upto.astype(np.int32), np.append(0, np.cumsum(np.bincount(names))).astype(np.int32)  # n is BASE_NAMES at most
    ranks = [(1, starts[names])]  # a rank is the number of smaller suffixes
    while True:
        rank = ranks[-1][1]
        at = np.flatnonzero((np.bincount(rank)[rank] > 1) & (upto[np.minimum(np.arange(n) + size, n)] - upto[:n] < limit))
        if not len(at):
            break
        second = np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + 1, 0).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        group, new = rank[at[order]], np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        begin = np.flatnonzero(new)
        inside = begin - first[np.searchsorted(first, begin, "right") - 1]
        finer = rank.copy()
        finer[at[order]] = (group[begin] + inside)[np.cumsum(new) - 1]
        size *= 2
        ranks.append((size, finer))
    order = np.argsort(rank, kind="stable")
    a, b, same = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for size, rank in reversed(ranks):
        p, q = a + same, b + same
        inside = (p + size <= n) & (q + size <= n)
        same += size * (inside & (rank[np.minimum(p, n - 1)] == rank[np.minimum(q, n - 1)]))
    shared = np.minimum(upto[a + same] - upto[a], limit).astype(np.uint8)
    return order, np.append(OPEN, shared)


def _extended(text: Text, places: np.ndarray, commons: np.ndarray) -> np.ndarray:
    """Common bytes of neighbours, where names know too few: one that ends as another goes on with its last symbol."""
    out = np.minimum(commons, text.limit).astype(np.int32)
    for begin in range(1, len(places), BLOCK):
        at = np.arange(begin, min(len(places), begin + BLOCK))
        while len(at):
            at = at[out[at] < text.limit]
            p, q = places[at - 1] + out[at], places[at] + out[at]
            like = text.symbols[p] == text.symbols[q]
            at, p, q = at[like], p[like], q[like]
            out[at] += np.minimum(text.run[p], text.run[q])
    return np.minimum(out, text.limit).astype(np.uint8)


def order(text: np.ndarray, limit: int, scratch: Scratch):
    """Blocks of places and of the bytes, up to ``limit``, shared with the place before, suffixes descending.

    ``text``: numbers from 1 on; a 0 that ends it is added.
    """
    top = int(text.max()) if len(text) else 0
    symbols = scratch.column(len(text) + 1, np.uint16 if top < 1 << 16 else np.int32)
    symbols[:-1] = text
    text = None
    for place, common, _ in sorted_suffixes(scratch, symbols, np.ones(top + 1, np.uint8), np.zeros(top + 1, np.uint8), limit):
        yield place, common
