"""Removal of repeated passages: every byte in a string of 100 bytes that also begins earlier in the corpus.

Sorting all suffixes of a corpus would shuffle it many times over. Two equal
100-byte windows agree in everything inside them, so each window is filed
under the smallest k-gram hash that it contains (its anchor), of which there
is one for 35 bytes on average. Only suffixes at equal anchors are sorted:

1. Each anchor stands for a run of windows; its context is their bytes. Of
   contexts with equal hashes (two, of 64 bits) all but the first are claims:
   this place repeats that one. Claims only say where to look.
2. Bytes are then brought together in two kinds of groups. Claims of a document
   that follow each other make a passage, which goes to the piece (cell) of the
   document that it repeats; the different contexts of an anchor go to that
   anchor.
3. In both, suffixes are sorted by mergesort. Two suffixes are compared by
   prefix polynomial hashes and binary search, in a logarithmic number of
   steps; the common extensions of neighbours in the order give the windows
   that are shared, and each is verified on the bytes before it counts.
4. Anchors with more different contexts than a task should hold hand their
   windows on to a distributed sort of the windows' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import shuffle_partitions, stacked, stored

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # k-grams in a window
MOST_CONTEXTS = 50_000  # different contexts of one anchor that a task holds: 9 MB of bytes at most
BATCH = 4096
NEARBY = 500_000  # contexts that are compared with each other before they are dealt
CELL = 1024  # windows of a piece of a document that copies are compared with
SALTS = 256  # copies of one cell are dealt to so many groups at most
_BASE2 = 0xD6E8FEB86659FD93
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
tb._powers.setdefault(_BASE2, np.ones(1, np.uint64))
tb._powers.setdefault(_INVERSE2, np.ones(1, np.uint64))
_INDEX_BITS = 20
_NO_ID = -(1 << 63)


class Hashes:
    """Prefix hashes of a piece of bytes with two bases."""

    def __init__(self, data: np.ndarray):
        self.first = tb.prefix_hashes(data)
        self.second = np.empty(len(data) + 1, np.uint64)
        self.second[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tb.powers(_BASE2, len(data)), out=self.second[1:])

    def one(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tb.mix(tb.span_hashes(self.first, start, end))

    def two(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tb.mix((self.second[end] - self.second[start]) * tb.powers(_INVERSE2, len(self.second))[start])


# ---- anchors ----


def _pieces(block: tb.Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, bounds, row of each text, its offset) with fewer than 2**20 bytes; pieces of a longer text overlap by a window less one."""
    limit = 1 << _INDEX_BITS
    if len(block.data) < limit:
        yield block.data, block.bounds, np.arange(len(block)) + block.first, np.zeros(len(block), np.int64)
        return
    for i in range(len(block)):  # one text, as a rule
        text = block.data[block.bounds[i] : block.bounds[i + 1]]
        for at in range(0, max(1, len(text) - LENGTH + 1), limit - LENGTH):
            part = text[at : at + limit - 1]
            yield part, np.array([0, len(part)]), np.array([block.first + i]), np.array([at])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, seed, context hash, anchor, first window, last window) of each anchor; positions are in ``data``.

    A window's anchor is the place of its smallest k-gram hash, the last of
    equal ones: it depends on the window's bytes alone.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    gram = hashes.one(at, at + GRAM)
    mask = np.uint64((1 << _INDEX_BITS) - 1)
    key = (gram & ~mask) | (mask - at.astype(np.uint64))
    for step in (1, 2, 4, 8, 16, 32):
        key = np.minimum(key[:-step], key[step:])  # the smallest of 64 at last
    key = np.minimum(key[: len(key) - (SPAN - 64)], key[SPAN - 64 :])
    where = (mask - (key & mask)).astype(np.int64)
    valid = np.ones(n - LENGTH + 1, bool)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[max(start, end - LENGTH + 1) : end] = False
    windows = np.flatnonzero(valid)
    if not len(windows):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    chosen = where[windows]
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    anchor, low, high = chosen[first], windows[first], windows[last]
    context = hashes.two(low, high + LENGTH) ^ tb.mix(((anchor - low) << 8 | (high - low)).astype(np.uint64))
    text = np.searchsorted(bounds, low, "right") - 1
    return text, gram[anchor].view(np.int64), context.view(np.int64), anchor, low, high


def _place(anchor, low, high):
    """Where a context lies in its document: its anchor and the windows' extent, in one number."""
    return anchor << 16 | (anchor - low) << 8 | (high - low)


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window)."""
    anchor = place >> 16
    low = anchor - (place >> 8 & 255)
    return anchor, low, low + (place & 255)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """Columns, of numbers or Arrow arrays, under the names of ``schema``."""
    made = [x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in columns]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in schema.split(", ")])


def _binary(rows: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values; null where not ``known``."""
    width = rows.shape[1] * rows.itemsize
    bounds = np.concatenate([[0], np.cumsum(known * width)]).astype(np.int32)
    buffers = [pa.array(known).buffers()[1], pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(rows[known]))]
    return pa.Array.from_buffers(pa.binary(), len(rows), buffers)


def _unpacked(column: pa.Array, kind: type = np.int64, width: int = 3) -> np.ndarray:
    """The numbers of _binary(), a row for each value that isn't null."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind).reshape(-1, width)


def _known_earlier(seed: np.ndarray, context: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts have the hashes of an earlier one among these, and the first such; ``spot`` is (doc, h, place)."""
    out, rep = np.zeros(len(seed), bool), np.zeros_like(spot)
    both = tb.mix(seed.view(np.uint64)) ^ context.view(np.uint64)
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    near = np.zeros(len(seed), bool)
    near[1:] |= same
    near[:-1] |= same
    some = order[near]
    if len(some):
        some = some[np.lexsort((*spot[some].T[::-1], context[some], seed[some]))]
        new = np.ones(len(some), bool)
        new[1:] = (seed[some][1:] != seed[some][:-1]) | (context[some][1:] != context[some][:-1])
        lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        out[some] = (spot[some] != spot[lead]).any(axis=1)
        rep[some] = spot[lead]
    return out, rep


ANCHOR = "seed long, context long, doc long, h long, place long, rep binary"


def text_anchors(texts: DataFrame) -> DataFrame:
    """Every anchor of ``texts`` (doc, h, text), with the place (doc, h, place) of an equal context if one is known.

    Those that have one nearby need not meet the others at their seed. So text
    that repeats within documents, or in many, doesn't pile up at one seed.
    """

    def settle(parts: list[tuple]) -> pa.RecordBatch:
        seed, context, doc, h, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, rep = _known_earlier(seed, context, np.stack([doc, h, place], axis=1))
        seed, context = np.where(known, 0, seed), np.where(known, 0, context)
        return _batch(ANCHOR, seed, context, doc, h, place, _binary(rep, known))

    def work(batches):
        parts, held = [], 0
        for b in batches:
            docs, hashes = (b.column(k).to_numpy() for k in range(2))
            for block in tb.blocks(b.column("text")):
                for data, bounds, rows, offset in _pieces(block):
                    text, seed, context, anchor, low, high = anchors(data, bounds)
                    if len(text):
                        row, off = rows[text], offset[text] - bounds[text]
                        parts.append((seed, context, docs[row], hashes[row], _place(anchor + off, low + off, high + off)))
                        held += len(seed)
                if held > NEARBY:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    return texts.mapInArrow(work, ANCHOR)


FIRST, CLAIM, CELL_OF = 0, 1, 2
NEED = "kind int, seed long, doc long, h long, place long, rep binary"


def _salt(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (tb.mix(doc.view(np.uint64) ^ tb.mix(h.view(np.uint64))) % np.uint64(SALTS)).astype(np.int64)


def _claims(doc, h, place, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Claims that a context equals the one at ``rep``, and the cells of documents that these need."""
    if not len(doc):
        return
    n = len(doc)
    yield _batch(NEED, np.full(n, CLAIM, np.int32), np.zeros(n, np.int64), doc, h, place, _binary(rep, np.ones(n, bool)))
    _, low, high = _placed(rep[:, 2])
    salt = _salt(np.ascontiguousarray(doc), np.ascontiguousarray(h))
    cells = np.concatenate([np.column_stack([rep[:, :2], (x // CELL) * SALTS + salt]) for x in (low, high)])
    cells = np.unique(cells, axis=0)
    n = len(cells)
    none = _binary(np.zeros((n, 3), np.int64), np.zeros(n, bool))
    yield _batch(NEED, np.full(n, CELL_OF, np.int32), np.zeros(n, np.int64), *cells.T, none)


def _firsts(seed, doc, h, place) -> pa.RecordBatch:
    n = len(seed)
    return _batch(NEED, np.full(n, FIRST, np.int32), seed, doc, h, place, _binary(np.zeros((n, 3), np.int64), np.zeros(n, bool)))


def matches(found: DataFrame, partitions: int) -> DataFrame:
    """What to look at: claims, the cells that they need, and the first of each different context of an anchor with several.

    Rows are read in order, and no group is held.
    """

    def work(batches):
        last, rep = None, np.zeros(3, np.int64)  # the last (seed, context) and its first place
        held = None  # the last first context, and whether its seed has one before it
        for b in batches:
            seed, context, doc, h, place = (b.column(k).to_numpy() for k in range(5))
            known = b.column(5).is_valid().to_numpy(zero_copy_only=False)
            yield from _claims(doc[known], h[known], place[known], _unpacked(b.column(5)))
            seed, context, doc, h, place = (x[~known] for x in (seed, context, doc, h, place))
            if not len(seed):
                continue
            first = np.ones(len(seed), bool)
            first[1:] = (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])
            first[0] = last is None or last != (seed[0], context[0])
            last = (seed[-1], context[-1])
            spot = np.stack([doc, h, place], axis=1)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(seed)), -1))
            reps = np.where((lead < 0)[:, None], rep, spot[lead])
            rep = reps[-1]
            again = (spot != reps).any(axis=1)
            yield from _claims(doc[again], h[again], place[again], reps[again])
            seed, doc, h, place = seed[first], doc[first], h[first], place[first]
            if held is not None:
                seed, doc, h, place = (np.concatenate([[x], y]) for x, y in zip(held, (seed, doc, h, place), strict=False))
            if not len(seed):
                continue
            more = np.zeros(len(seed), bool)
            more[1:] = seed[1:] == seed[:-1]
            if held is not None:
                more[0] = held[4]
            keep = more.copy()
            keep[:-1] |= more[1:]
            keep[-1] = False
            yield _firsts(seed[keep], doc[keep], h[keep], place[keep])
            held = (seed[-1], doc[-1], h[-1], place[-1], bool(more[-1]))
        if held is not None and held[4]:
            yield _firsts(*[np.array([x], np.int64) for x in held[:4]])

    known = F.col("rep").isNotNull()
    dealt = found.repartition(partitions, F.when(known, F.xxhash64("h", "place")).otherwise(F.col("seed")))
    return dealt.sortWithinPartitions(known, "seed", "context", "doc", "h", "place").mapInArrow(work, NEED)


# ---- suffix sort by hash comparison ----


class Suffixes:
    """Suffixes data[start:end] of a buffer; ``begin`` bounds how far one can be extended to the left."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.start, self.end = data, begin, start, end
        self.prefix = tb.prefix_hashes(data)
        self.inverse = tb.powers(tb.INVERSE, len(data) + 1)

    def _equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        one = (self.prefix[a + n] - self.prefix[a]) * self.inverse[a]
        return one == (self.prefix[b + n] - self.prefix[b]) * self.inverse[b]

    def common(self, x: np.ndarray, y: np.ndarray, left: bool = False) -> np.ndarray:
        """Length of the common extension of suffixes x and y to the right, or to the left: binary search on hashes."""
        a, b = self.start[x], self.start[y]
        if left:
            most = np.minimum(a - self.begin[x], b - self.begin[y])
        else:
            most = np.minimum(self.end[x] - a, self.end[y] - b)
        low, high = np.zeros(len(a), np.int64), most.copy()
        while np.any(low < high):
            mid = (low + high + 1) >> 1
            same = self._equal(a - mid, b - mid, mid) if left else self._equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray, left: bool = False) -> np.ndarray:
        """Whether suffix x sorts before y (to the left: read backwards); equal ones as told."""
        n = self.common(x, y, left)
        size = len(self.data) - 1
        if left:
            a, b = self.start[x] - n - 1, self.start[y] - n - 1
            at_end, other_end = a < self.begin[x], b < self.begin[y]
        else:
            a, b = self.start[x] + n, self.start[y] + n
            at_end, other_end = a >= self.end[x], b >= self.end[y]
        smaller = self.data[np.clip(a, 0, size)] < self.data[np.clip(b, 0, size)]
        return np.where(at_end, ~other_end | or_equal, ~other_end & smaller)

    def sort(self, first: np.ndarray, left: bool = False) -> np.ndarray:
        """Mergesort of each group first[g]:first[g + 1], all groups level by level.

        An item's place in the merged run is its place in its own and its rank in the other run, by binary search.
        """
        sizes = np.diff(first)
        base = np.repeat(first[:-1], sizes)
        stop = base + np.repeat(sizes, sizes)
        local = np.arange(len(base)) - base
        order = np.arange(len(base))
        width = 1
        while len(sizes) and width < sizes.max():
            run = local // width
            earlier = run % 2 == 0
            other = base + (run ^ 1) * width
            low, high = np.minimum(other, stop), np.minimum(other + width, stop)
            begin = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                before = self.less(order[mid], order[live], ~earlier[live], left)  # of equals, those of the earlier run come first
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
                live = live[low[live] < high[live]]
            pair = base + (run & ~1) * width
            target = pair + (local - run * width) + (low - begin)
            moved = np.empty_like(order)
            moved[target] = order
            order = moved
            width *= 2
        return order


def _verified(s: Suffixes, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The claimed extensions checked on the bytes; a pair with a hash collision is compared byte by byte."""
    total = left + right
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    same = s.data[np.repeat(s.start[x] - left, total) + at] == s.data[np.repeat(s.start[y] - left, total) + at]
    bad = np.unique(np.repeat(np.arange(len(x)), total)[~same])
    for i in bad.tolist():
        a, b = int(s.start[x[i]]), int(s.start[y[i]])
        n = next((k for k in range(int(right[i])) if s.data[a + k] != s.data[b + k]), int(right[i]))
        m = next((k for k in range(int(left[i])) if s.data[a - 1 - k] != s.data[b - 1 - k]), int(left[i]))
        left[i], right[i] = m, n
    return left, right


def shared_windows(s: Suffixes, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows of each suffix's context an earlier member of its group has too: a row of SPAN flags each.

    Members are in document order. ``windows`` counts each context's windows;
    flag j is for the one that begins j bytes behind ``begin``.

    The suffixes are sorted to the right and to the left. Members whose first
    r bytes agree are neighbours in the one sort, and with l bytes before the
    anchor in common they are in the other, so two numbers name a window:
    there are SPAN splits of its length into l and r. n log n for any group.
    """
    n = len(s.start)
    out = np.zeros((n, SPAN), bool)
    if n < 2:
        return out
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    right, left = s.sort(first), s.sort(first, left=True)
    none = np.zeros(n - 1, np.int64)
    inside = group[1:] == group[:-1]
    _, r = _verified(s, right[:-1], right[1:], none, np.where(inside, s.common(right[:-1], right[1:]), 0))
    back, _ = _verified(s, left[:-1], left[1:], np.where(inside, s.common(left[:-1], left[1:], left=True), 0), none.copy())
    reach, names = s.start - s.begin, np.empty((2, n), np.int64)
    for l in range(SPAN):
        names[0][right] = np.cumsum(np.concatenate([[0], r < LENGTH - l]))  # 0 at the first of a group, so no name spans two
        names[1][left] = np.cumsum(np.concatenate([[0], back < l]))
        at = reach - l  # where the window begins behind ``begin``
        has = np.flatnonzero((at >= 0) & (at < windows))
        order = has[np.lexsort((has, names[1][has], names[0][has]))]  # members are in document order
        again = (names[:, order[1:]] == names[:, order[:-1]]).all(axis=0)
        late = order[1:][again]
        out[late, at[late]] = True
    return out


def shared_prefixes(s: Suffixes, first: np.ndarray) -> np.ndarray:
    """How many bytes each suffix has in common with the first member of its group, by the order of suffixes.

    That is the least common extension of neighbours between the two places in
    the order; each extension is verified on the bytes.
    """
    n = len(s.start)
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = s.sort(first)
    lead = np.zeros(n, bool)
    lead[first[:-1]] = True
    lead = lead[order]
    same = group[1:] == group[:-1]
    none = np.zeros(n - 1, np.int64)
    _, step = _verified(s, order[:-1], order[1:], none, np.where(same, s.common(order[:-1], order[1:]), 0))
    most = int((s.end - s.start).max(initial=0)) + 1

    def outward(steps: np.ndarray, lead: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Running minimum of ``steps`` from each leader on: a later segment's numbers are all smaller, so it starts anew."""
        segment = np.cumsum(lead | edge)
        return np.minimum.accumulate(np.where(lead, most, steps) - segment * (most + 1)) + segment * (most + 1)

    ends = np.concatenate([[True], ~same])
    forth = outward(np.concatenate([[0], step]), lead, ends)
    ends = np.concatenate([~same, [True]])
    back = outward(np.concatenate([step, [0]])[::-1], lead[::-1], ends[::-1])[::-1]
    where = np.flatnonzero(lead)[group]
    out = np.empty(n, np.int64)
    out[order] = np.where(np.arange(n) >= where, forth, back)
    return np.minimum(out, s.end - s.start)


# ---- bytes to compare ----

PASSAGE = "k1 long, k2 long, k3 long, kind int, doc long, h long, low long, at long, bytes binary"


def _runs(row: np.ndarray, place: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Claims that follow each other, merged and cut at the cells: (row, rep_doc, rep_h, cell, at, low, windows)."""
    _, low, high = _placed(place)
    delta = _placed(rep[:, 2])[1] - low
    order = np.lexsort((low, delta, rep[:, 1], rep[:, 0], row))
    row, low, high, delta, rep = row[order], low[order], high[order], delta[order], rep[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (delta[1:] != delta[:-1]) | (rep[1:, :2] != rep[:-1, :2]).any(axis=1) | (low[1:] > high[:-1] + 1)
    at = np.flatnonzero(new)
    row, delta, rep = row[at], delta[at], rep[at]
    begin, end = low[at] + delta, np.maximum.reduceat(high, at) + delta if len(at) else high
    cells = end // CELL - begin // CELL + 1
    run = np.repeat(np.arange(len(at)), cells)
    cell = begin[run] // CELL + np.arange(len(run)) - np.repeat(np.cumsum(cells) - cells, cells)
    start, stop = np.maximum(begin[run], cell * CELL), np.minimum(end[run], cell * CELL + CELL - 1)
    return row[run], rep[run, 0], rep[run, 1], cell, start - cell * CELL, start - delta[run], stop - start + 1


def passages(rows: DataFrame) -> DataFrame:
    """The bytes of contexts, claimed passages and cells, from (doc, h, text, needs)."""

    def work(batches):
        for b in batches:
            docs, hashes = (b.column(c).to_numpy() for c in ("doc", "h"))
            raw = [t.encode("utf-8") for t in b.column("text").to_pylist()]
            needs = b.column("needs")
            row = np.repeat(np.arange(len(raw)), needs.value_lengths().to_numpy())
            kind, seed, place, rep = needs.flatten().flatten()
            kind, seed, place = kind.to_numpy(), seed.to_numpy(), place.to_numpy()
            out = []

            first = np.flatnonzero(kind == FIRST)
            anchor, low, high = _placed(place[first])
            zero = np.zeros(len(first), np.int64)
            out.append((seed[first], zero, zero - 1, zero, row[first], low, anchor - low, high - low + LENGTH))

            which = np.flatnonzero(kind == CELL_OF)
            pair = np.unique(np.column_stack([row[which], place[which]]), axis=0).reshape(-1, 2)
            of, low = pair[:, 0], pair[:, 1] // SALTS * CELL
            zero = np.zeros(len(pair), np.int64)
            out.append((docs[of], hashes[of], pair[:, 1], zero, of, low, zero, zero + CELL + LENGTH - 1))

            which = np.flatnonzero(kind == CLAIM)
            of, k1, k2, cell, at, low, n = _runs(row[which], place[which], _unpacked(rep))
            out.append((k1, k2, cell * SALTS + _salt(docs[of], hashes[of]), np.ones(len(of), np.int64), of, low, at, n + LENGTH - 1))

            k1, k2, k3, kind, of, low, at, size = (np.concatenate(x) for x in zip(*out, strict=True))
            cut = [raw[i][x : x + y] for i, x, y in zip(of.tolist(), low.tolist(), size.tolist(), strict=True)]
            yield _batch(PASSAGE, k1, k2, k3, kind.astype(np.int32), docs[of], hashes[of], low, at, pa.array(cut, pa.binary()))

    return rows.select("doc", "h", "text", "needs").mapInArrow(work, PASSAGE)


# ---- from bytes to removed windows ----

PART = "key long, second long, window binary, doc long, h long, low long, high long"


def _ranges(doc, h, low, high) -> pa.RecordBatch:
    return _batch(PART, h, doc, pa.nulls(len(doc), pa.binary()), doc, h, low, high)


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    """The numbers of (k1, k2, k3, kind, doc, h, low, at, bytes) rows."""
    return list(np.array([r[:8] for r in rows], np.int64).reshape(-1, 8).T)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where each part begins, where it ends)."""
    end = np.cumsum([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], end[:-1]]), end


def _sorted_contexts(rows: list[tuple]) -> pa.RecordBatch:
    """Removed windows of whole groups of different contexts, in document order within a group."""
    seed, _, _, _, doc, h, low, at = _columns(rows)
    data, begin, end = _joined([r[8] for r in rows])
    s = Suffixes(data, begin, begin + at, end)
    first = np.concatenate([[0], np.flatnonzero(seed[1:] != seed[:-1]) + 1, [len(seed)]])
    flags = shared_windows(s, first, end - begin - LENGTH + 1)
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return _ranges(doc[row], h[row], low[row] + start, low[row] + stop - 1)


def _sorted_copies(cells: list[bytes], of: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Removed windows of passages that are claimed to begin ``at`` bytes within their cell."""
    _, _, _, _, doc, h, low, at = _columns(rows)
    data, begin, end = _joined([*cells, *(r[8] for r in rows)])
    cell = np.array(of, np.int64)
    suffix, group = np.unique(cell * (CELL + LENGTH) + at, return_inverse=True)
    own, k = suffix // (CELL + LENGTH), len(cells)
    start = np.concatenate([begin[own] + suffix % (CELL + LENGTH), begin[k:]])
    stop = np.concatenate([end[own], end[k:]])
    group = np.concatenate([np.arange(len(suffix)), group])
    order = np.argsort(group, kind="stable")  # the cell's suffix comes first in its group
    first = np.searchsorted(group[order], np.arange(len(suffix) + 1))
    s = Suffixes(data, start[order], start[order], stop[order])
    shared = np.empty(len(order), np.int64)
    shared[order] = shared_prefixes(s, first)
    n = shared[len(suffix) :] - LENGTH + 1
    has = n > 0
    return _ranges(doc[has], h[has], low[has], (low + n - 1)[has])


def _open_windows(row: tuple) -> pa.RecordBatch:
    """Every window of a context with its bytes, for the distributed sort; two hashes deal them."""
    _, _, _, _, doc, h, low, _, context = row
    data = np.frombuffer(context, np.uint8)
    hashes, at = Hashes(data), np.arange(len(data) - LENGTH + 1)
    one, two = hashes.one(at, at + LENGTH).view(np.int64), hashes.two(at, at + LENGTH).view(np.int64)
    windows = _binary(np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.ones(len(at), bool))
    return _batch(PART, one, two, windows, np.full(len(at), doc), np.full(len(at), h), low + at, low + at)


def sorted_passages(found: DataFrame, partitions: int) -> DataFrame:
    """Sort the suffixes of each group; windows of anchors with more than MOST_CONTEXTS contexts are handed on open.

    Groups of a cell are of any size: its copies are read some at a time.
    """

    def work(batches):
        done: list[tuple] = []  # whole groups of contexts, to be sorted together
        group: list[tuple] = []  # the anchor being read
        large = False
        cells: list[bytes] = []
        of: list[int] = []
        copies: list[tuple] = []
        key, before = None, None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if row[:3] != key:
                    done += group
                    key, group, large = row[:3], [], False
                    if len(done) > BATCH:
                        yield _sorted_contexts(done)
                        done = []
                    if key[2] >= 0:
                        if len(cells) > BATCH:
                            yield _sorted_copies(cells, of, copies)
                            cells, of, copies = [], [], []
                        cells.append(row[8])
                if key[2] >= 0:
                    if row[3]:
                        of.append(len(cells) - 1)
                        copies.append(row)
                        if len(copies) > BATCH:
                            yield _sorted_copies(cells, of, copies)
                            cells, of, copies = cells[-1:], [], []
                    continue
                if row[4:7] == before:
                    continue  # of a repeated row
                before = row[4:7]
                if large:
                    yield _open_windows(row)
                    continue
                group.append(row)
                if len(group) > MOST_CONTEXTS:
                    large = True
                    yield from map(_open_windows, group)
                    group = []
        if done or group:
            yield _sorted_contexts(done + group)
        if copies:
            yield _sorted_copies(cells, of, copies)

    ordered = found.repartition(partitions, "k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "kind", "doc", "h", "low")
    return ordered.mapInArrow(work, PART)


def settled(parts: DataFrame, partitions: int) -> DataFrame:
    """(doc, h, low, high) of removed windows: ranges pass, and of open windows with equal bytes all but the first are removed."""
    schema = "doc long, h long, low long, high long"

    def work(batches):
        last = None
        for b in batches:
            is_open = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            doc, h, low, high = (b.column(k).to_numpy() for k in range(3, 7))
            windows = _unpacked(b.column(2), np.uint8, LENGTH)
            again = np.zeros(len(windows), bool)
            again[1:] = (windows[1:] == windows[:-1]).all(axis=1)
            if len(windows):
                again[0] = last == windows[0].tobytes()
                last = windows[-1].tobytes()
            keep = ~is_open
            keep[is_open] = again
            yield _batch(schema, doc[keep], h[keep], low[keep], high[keep])

    is_open = F.col("window").isNotNull()
    dealt = parts.repartition(partitions, "key", "second")
    ordered = dealt.sortWithinPartitions(is_open, F.when(is_open, F.col("key")), "window", "doc", "h", "low")
    return ordered.mapInArrow(work, schema)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(raw: bytes, ranges) -> tuple[int, int, int, str]:
    if not ranges:
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    low, high = (np.array([r[k] for r in ranges], np.int64) for k in ("low", "high"))
    n = len(raw) + 1
    gone = np.cumsum(np.bincount(low, minlength=n) - np.bincount(high + LENGTH, minlength=n))[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 with every byte removed that an earlier equal 100-byte string covers.

    Earlier is a smaller doc_id (null is the smallest), or an earlier start in
    the same document. Rows with one doc_id, or without, and different texts
    are told apart and ordered by a 64-bit hash of the text; equal repeated
    rows are one document and get the same result. A null text is empty; texts
    of fewer than 100 bytes stay whole and are not shuffled. No documents, no
    rows.

    Nothing is removed that isn't equal byte by byte. Something could only be
    missed if two different contexts had both 64-bit hashes in common.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    whole = F.octet_length("text") < LENGTH
    short = rows.filter(whole).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    texts = rows.filter(~whole).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    found = stored(matches(text_anchors(texts), parts), "matches")
    # The texts are dealt once; both joins below read that one exchange.
    dealt = texts.repartition(parts, "doc", "h")
    needs = found.groupBy("doc", "h").agg(F.collect_list(F.struct("kind", "seed", "place", "rep")).alias("needs"))
    ranges = settled(sorted_passages(passages(dealt.join(needs, ["doc", "h"])), parts), parts)
    gone = ranges.groupBy("doc", "h").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def work(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("doc", "text", "ranges"))
            rows = [(doc, *_kept(t.encode("utf-8"), r)) for doc, t, r in zip(*cols, strict=True)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield _batch(RESULT, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types)))

    out = dealt.join(gone, ["doc", "h"], "left").select("doc", "text", "ranges").mapInArrow(work, RESULT)
    doc_id = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    return stacked(out.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"), short)
