"""Self-join of documents on the Jaccard similarity of their word n-gram sets, exact.

Every n-gram is hashed into one of ``GROUPS`` groups, and a document becomes
the point of its group counts.  The n-grams that two documents share are at
most the sum over groups of the smaller count, so an R-tree over such points
can drop whole pairs of subtrees: a node's upper corner bounds the counts of
all below it.  Pairs that survive are verified on the n-grams themselves.

Over a whole corpus one tree would look at all pairs of leaves, as hashed
counts of unrelated texts of one length lie close together.  So documents are
first routed to cells, and a tree is built in each.  The routing loses no pair:

1. N-grams are counted by the sets that hold them.  One that a single set
   holds is shared with nobody.  A set of n of which fewer than t n are held
   elsewhere has no partner at threshold t and is out.
2. Of what a set shares, in a common order from rare to frequent, a partner at
   t must hold one of the first ``shared - t n + 1``; the first that both hold
   is among those of both.
3. Sets that meet under such an n-gram get a common cell, named after the
   least of them, so that a group of near copies, which meet under hundreds of
   n-grams, is one cell and not hundreds.

Documents of one n-gram set are one class and go through the join once, so
that thousands of copies cost as much as one.  N-grams are shuffled in packed
arrays, a few bytes each.  Frequent ones (found by bounded summaries of all
tasks) don't gather anywhere: they are dealt out by class, and only the least
class of each is looked for and told to all.  A large cell is compared as
pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import bytesops as B
from spanloom.llm.graph import by_document, least_rows, linked
from spanloom.llm.store import by_size, discard, materialise, trimmed

N, THRESHOLD = 3, 0.5
GROUPS = 128
#: Fan-out of the tree.
FAN = 16
#: Sets of a cell that one task compares; a larger cell becomes pairs of such blocks.
BLOCK = 2048
#: N-grams are told apart by the leading 40 + k bits of their hash, where 2^k partitions are shuffled to,
#: and a partition is to hold about so many.
REST_BITS, PART_GRAMS = 40, 1 << 21
#: An n-gram of so many documents, and of one in FREQUENT_SHARE of a task's, is frequent; at most so many are.
FREQUENT, FREQUENT_SHARE, MOST_FREQUENT = 1 << 15, 4096, 1 << 16
#: Sets that meet under one n-gram are compared in size and place pair by pair where they are so few.
SMALL = 64

_SHIFT = np.uint64(64 - GROUPS.bit_length() + 1)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_SIGN = np.uint64(1 << 63)
#: Codes of how many sets hold an n-gram: the number up to EXACT, then its logarithm; FREQUENT_CODE for the frequent.
EXACT, FREQUENT_CODE = 200, 255


def gram_sets(column: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents i..j: (i, j, hashes, document of each), hashes distinct and sorted in each document.

    Words are runs of letters, marks, digits and underscores of the text in
    lower case, and single characters in scripts without spaces.  Fewer than n
    words are one n-gram.
    """
    raw, offsets, _ = B.text_buffers(pc.utf8_lower(column))
    for i, j in B.doc_chunks(offsets):
        part = raw[offsets[i] : offsets[j]]
        start, length, doc = B.word_spans(part, offsets[i : j + 1] - offsets[i])
        if not len(start):
            yield i, j, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        h = B.hash_slices(B.padded(part), start, length)
        words = np.bincount(doc, minlength=j - i)
        ends = np.cumsum(words)
        place = np.arange(len(h)) - (ends - words)[doc]
        first = np.flatnonzero((place == 0) | (place + n <= words[doc]))
        d = doc[first]
        left = ends[d] - first
        g = np.zeros(len(first), np.uint64)
        for k in range(n):
            inside = left > k
            g += np.where(inside, h[np.minimum(first + k, len(h) - 1)], np.uint64(0)) * (_MUL[k % 8] + np.uint64(2 * (k // 8)))
        g = B.mix64(g)
        cut = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=j - i))]).tolist()
        for a, b in zip(cut[:-1], cut[1:]):
            g[a:b].sort()
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        yield i, j, g[new], d[new]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def set_keys(g: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """64 bits for each document's set, equal for equal sets."""
    out = np.zeros(docs, np.uint64)
    at = _starts(d)
    if len(at):
        out[d[at]] = B.mix64(np.add.reduceat(B.mix64(g * _MUL[0] + _MUL[2]), at))
    return out


def group_counts(g: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """The point of each document: n-grams in each group."""
    group = (g * _MUL[1] >> _SHIFT).astype(np.int64)
    return np.bincount(d * GROUPS + group, minlength=docs * GROUPS).reshape(docs, GROUPS)


class CountTree:
    """A packed R-tree over group counts; level 0 holds the points, a node of a level covers FAN of the level below."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        # bulk loading in tiles: by size, then by the two coordinates that vary most
        m = len(sizes)
        rank = np.lexsort((np.arange(m), sizes))
        if m > FAN * FAN:
            wide = np.argsort(-counts.astype(np.float64).var(axis=0), kind="stable")[:2]
            tile = (np.argsort(rank, kind="stable") * math.ceil(math.sqrt(m / FAN))) // m
            rank = np.lexsort((np.arange(m), counts[:, wide[1]], counts[:, wide[0]] // 2, tile))
        self.order = rank
        self.high, self.least, self.most = [counts[rank]], [sizes[rank]], [sizes[rank]]
        while len(self.least[-1]) > 1:
            at = np.arange(0, len(self.least[-1]), FAN)
            self.high.append(np.maximum.reduceat(self.high[-1], at, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows (a, b) whose bound allows the threshold, each pair once."""
        u = v = np.zeros(1, np.int64)
        for level in range(len(self.high) - 1, -1, -1):
            if level < len(self.high) - 1:
                u, v = self._children(u, v, len(self.least[level]), level == 0)
            u, v = self._bounded(u, v, level, threshold)
        if len(self.high) == 1:
            u = v = np.zeros(0, np.int64)
        return self.order[u], self.order[v]

    @staticmethod
    def _children(u, v, n, last):
        i, j = np.divmod(np.arange(FAN * FAN), FAN)
        cu, cv = (u[:, None] * FAN + i).ravel(), (v[:, None] * FAN + j).ravel()
        ok = (cu < n) & (cv < n) & (cu < cv if last else cu <= cv)
        return cu[ok], cv[ok]

    def _bounded(self, u, v, level, threshold):
        high, least, most = self.high[level], self.least[level], self.most[level]
        share = threshold / (1 + threshold)
        ok = (most[u] >= threshold * least[v] - 1e-9) & (most[v] >= threshold * least[u] - 1e-9)
        u, v = u[ok], v[ok]
        keep = np.zeros(len(u), bool)
        for a in range(0, len(u), 4096):
            x, y = u[a : a + 4096], v[a : a + 4096]
            keep[a : a + 4096] = np.minimum(high[x], high[y]).sum(axis=1) >= share * (least[x] + least[y]) - 1e-9
        return u[keep], v[keep]


def join_sets(sets: list[np.ndarray], threshold: float, sizes: np.ndarray | None = None, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, overlap) of the pairs of sorted hash arrays that reach the threshold.

    ``sizes`` are the sets' own where the arrays leave out what no other holds.
    """
    held = np.array([len(s) for s in sets], np.int64)
    sizes = held if sizes is None else sizes
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    a, b = CountTree(group_counts(flat, np.repeat(np.arange(len(sets)), held), len(sets)), sizes).pairs(threshold)
    if allowed is not None and len(a):
        ok = allowed(a, b)
        a, b = a[ok], b[ok]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.cumsum(held) - held
    overlap = np.zeros(len(a), np.int64)
    cuts = [*_starts(a).tolist(), len(a)]
    for s, e in zip(cuts[:-1], cuts[1:]):
        x = sets[a[s]]
        for s in range(s, e, 1024):  # one set against many at once
            y = b[s : min(s + 1024, e)]
            ends = np.cumsum(held[y])
            values = flat[np.arange(ends[-1]) + np.repeat(first[y] - (ends - held[y]), held[y])]
            at = np.searchsorted(x, values)
            at[at == len(x)] = 0
            found = np.concatenate([[0], np.cumsum(x[at] == values)])
            overlap[s : s + len(y)] = found[ends] - found[ends - held[y]]
    ok = overlap >= threshold * (sizes[a] + sizes[b] - overlap) - 1e-9
    return a[ok], b[ok], overlap[ok]


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _unpacked(blob, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _blobs(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array of the bytes of rows cuts[k]..cuts[k+1]."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim == 2 else 1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _runs(d: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, none longer than a 16-bit count."""
    at = _starts(d)
    if len(at) and np.diff(np.append(at, len(d))).max() > 65535:
        at = np.unique(np.concatenate([at, *(np.arange(s, e, 65535) for s, e in zip(at, np.append(at[1:], len(d))))]))
    return at


#: Rows of packed n-grams: for classes ``cs``, of ``sizes`` n-grams, ``counts`` n-grams each, in partition ``part`` their ``rest``; ``more`` goes with each.
_PACKED = "goes int, part int, cs binary, sizes binary, counts binary, rest binary, more binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _pack(goes, part, cut_entries, cut_runs, cs, sizes, counts, rest, more) -> pa.RecordBatch:
    some = cut_runs[1:] > cut_runs[:-1]
    columns = [pa.array(goes, pa.int32()), pa.array(part, pa.int32()), _blobs(cs, cut_runs), _blobs(sizes, cut_runs), _blobs(counts, cut_runs), _blobs(rest, cut_entries), _blobs(more, cut_entries)]
    return pa.RecordBatch.from_arrays([c.filter(pa.array(some)) for c in columns], _NAMES)


class _Entries:
    """Packed rows of a partition, put together."""

    def __init__(self, width: int):
        self.width, self.rows = width, []

    def add(self, batch: pa.RecordBatch, keep=lambda part: True) -> None:
        for k, part in enumerate(batch.column(1).to_pylist()):
            if keep(part):
                cs, sizes, counts, rest, more = (batch.column(i)[k].as_buffer() for i in range(2, 7))
                key = _unpacked(rest, self.width)
                if part >= 0:
                    key |= np.uint64(part) << np.uint64(REST_BITS)
                self.rows.append((np.frombuffer(cs, np.uint64), np.frombuffer(sizes, np.uint32), np.frombuffer(counts, np.uint16), key, np.frombuffer(more, np.uint8)))

    def all(self):
        """(classes in order, size of each, class number of each n-gram, n-grams, more of each)."""
        cs, sizes, counts, key, more = (np.concatenate(x) for x in zip(*self.rows))
        self.rows = []
        uc, at, inv = np.unique(cs, return_index=True, return_inverse=True)
        return uc, sizes[at], np.repeat(inv.astype(np.int64), counts), key, more


def _by_gram(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The order by n-gram, then class; repeated pairs only once."""
    if len(key) and int(of.max()) < 1 << 24:
        order = np.argsort(((key & np.uint64((1 << REST_BITS) - 1)) << np.uint64(24)) | of.astype(np.uint64))
    else:
        order = np.lexsort((of, key))
    k, o = key[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return order[new]


def _signatures(n):
    """(id, class, size) of each document, then the task's own frequent n-grams in a row without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, kept, held = 0, [], 0
        for batch in batches:
            for i, j, g, d in gram_sets(batch.column(1), n):
                sizes = np.bincount(d, minlength=j - i)
                docs += j - i
                u, c = np.unique(g, return_counts=True)
                kept.append((u[c > 1], c[c > 1]))
                held += len(kept[-1][0])
                if held > 1 << 20:
                    kept = [_summed(kept, 1 << 18)]
                    held = len(kept[0][0])
                c = pa.array(set_keys(g, d, j - i).view(np.int64), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), c, pa.array(sizes), pa.nulls(j - i, pa.binary())], ["id", "c", "n", "frequent"])
                id_type = batch.column(0).type
        if kept:
            u, c = _summed(kept, 1 << 14)
            some = c >= max(16, docs // FREQUENT_SHARE)
            blob = np.stack([u[some], c[some].astype(np.uint64)]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], ["id", "c", "n", "frequent"])

    return run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes added up, the ``most`` largest."""
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    c = np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
    if len(u) > most:
        best = np.sort(np.argsort(-c, kind="stable")[:most])
        u, c = u[best], c[best]
    return u, c


def _merge_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of several tasks as one of bounded size."""
    parts = []
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            parts.append(tuple(np.frombuffer(blob, np.uint64).reshape(2, -1)))
            if len(parts) > 64:
                parts = [_summed(parts, 4 * MOST_FREQUENT)]
    if parts:
        u, c = _summed(parts, 4 * MOST_FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([np.stack([u, c.astype(np.uint64)]).tobytes()], pa.binary())], ["frequent"])


def _spread(n, bits, frequent):
    """Each document's n-grams, packed by the partition that they go to; its size, and its frequent n-grams, to its class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        parts, drop = 1 << bits, np.uint64(64 - REST_BITS - bits)
        for batch in batches:
            for i, j, g, d in gram_sets(batch.column(0), n):
                if not len(g):
                    continue
                c = set_keys(g, d, j - i)
                own = np.zeros(j - i, bool)
                has = np.unique(d)
                own[has[np.unique(c[has], return_index=True)[1]]] = True  # copies in one run go once
                key = g >> drop
                keep = own[d]
                keep[1:] &= (key[1:] != key[:-1]) | (d[1:] != d[:-1])
                key, d = key[keep], d[keep]
                size = np.bincount(d, minlength=j - i).astype(np.uint32)
                known = np.isin(key, common) if len(common) else np.zeros(len(key), bool)
                # rare n-grams by their leading bits
                k, e = key[~known], d[~known]
                part = (k >> np.uint64(REST_BITS)).astype(np.int64)
                order = np.argsort(part.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
                k, e, part = k[order], e[order], part[order]
                at = _runs(part * (j - i) + e)
                ids = np.arange(parts)
                yield _pack(ids, ids, np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[at], np.arange(parts + 1)), c[e[at]], np.zeros((len(at), 0), np.uint8), np.diff(np.append(at, len(k))).astype(np.uint16), _packed(k & np.uint64((1 << REST_BITS) - 1), 5), np.zeros((len(k), 0), np.uint8))
                # sizes and frequent n-grams by class; a class's own number comes first, so that every class has a run
                who = np.flatnonzero(own)
                who = who[np.argsort(c[who])]
                place = np.full(j - i, -1)
                place[who] = np.arange(len(who))
                k = np.concatenate([np.zeros(len(who), np.uint64), key[known]])
                e = np.concatenate([np.arange(len(who)), place[d[known]]])
                more = np.concatenate([np.zeros(len(who), np.uint8), np.full(int(known.sum()), FREQUENT_CODE, np.uint8)])
                order = np.argsort(e, kind="stable")
                k, e, more = k[order], e[order], more[order]
                at = _runs(e)
                goes = (c[who] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(who), np.int64)
                yield _pack(ids, np.full(parts, -1), np.searchsorted(goes[e], np.arange(parts + 1)), np.searchsorted(goes[e[at]], np.arange(parts + 1)), c[who][e[at]], size[who][e[at]], np.diff(np.append(at, len(k))).astype(np.uint16), _packed(k, 8), more)

    return run


def _shared(bits):
    """Of a partition's n-grams those that several classes hold, packed by class, with the code of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = _Entries(5), None
        for batch in batches:
            own = pc.equal(batch.column(1), -1)
            yield batch.filter(own)
            rest = batch.filter(pc.invert(own))
            if rest.num_rows:
                part = rest.column(1)[0].as_py()
                held.add(rest)
        if part is None:
            return
        for row in range(len(held.rows)):  # sizes aren't sent along here
            cs, _, *others = held.rows[row]
            held.rows[row] = (cs, np.zeros(len(cs), np.uint32), *others[:-1], np.zeros(0, np.uint8))
        uc, _, of, key, _ = held.all()
        order = _by_gram(key, of)
        key, of = key[order], of[order]
        at = _starts(key)
        many = np.diff(np.append(at, len(key)))
        code = np.where(many <= EXACT, many, np.minimum(EXACT + 3 * np.log2(np.maximum(many, 1) / EXACT) + 1, FREQUENT_CODE - 1)).astype(np.uint8)
        live = np.repeat(many > 1, many)
        code = np.repeat(code, many)[live]
        key, of = key[live], of[live]
        order = np.argsort(of, kind="stable")
        key, of, code = key[order], of[order], code[order]
        at = _runs(of)
        goes = (uc >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(uc), np.int64)
        cuts = np.arange((1 << bits) + 1)
        yield _pack(cuts[:-1], np.full(1 << bits, part), np.searchsorted(goes[of], cuts), np.searchsorted(goes[of[at]], cuts), uc[of[at]], np.zeros((len(at), 0), np.uint8), np.diff(np.append(at, len(of))).astype(np.uint16), _packed(key & np.uint64((1 << REST_BITS) - 1), 5), code)

    return run


#: What is left of a class: its size, the n-grams that others hold too (6 or 8 bytes each); and packed n-grams under which it may meet a partner.
_LEFT = f"c long, n int, grams binary, {_PACKED}"


def _survivors(bits, threshold):
    width = 6 if REST_BITS + bits <= 48 else 8
    names = ["c", "n", "grams", *_NAMES]
    schema = pa.schema([("c", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("goes", pa.int32()), ("part", pa.int32()), *((x, pa.binary()) for x in _NAMES[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, own = _Entries(5), _Entries(8)
        for batch in batches:
            rare.add(batch, lambda part: part >= 0)
            own.add(batch, lambda part: part < 0)
        if not own.rows:
            return
        uc, size, of, key, code = own.all()
        extra = code > 0  # frequent ones, of each copy that was sent
        of, key, code = of[extra], key[extra], code[extra]
        if rare.rows:
            found = [(np.searchsorted(uc, cs), counts, k, m) for cs, _, counts, k, m in rare.rows]
            of = np.concatenate([of, *(np.repeat(w, n) for w, n, _, _ in found)])
            key, code = np.concatenate([key, *(x[2] for x in found)]), np.concatenate([code, *(x[3] for x in found)])
        order = np.lexsort((key, of))
        key, of, code = key[order], of[order], code[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, of, code = key[new], of[new], code[new]
        shared = np.bincount(of, minlength=len(uc))
        need = np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int64), 1)
        stays = shared >= need
        ok = stays[of]
        key, of, code = key[ok], of[ok], code[ok]
        who = np.flatnonzero(stays)
        cuts = np.searchsorted(of, np.append(who, len(uc)))
        table = [pa.array(uc[who].view(np.int64)), pa.array(size[who].astype(np.int32)), _blobs(_packed(key, width), cuts)]
        yield pa.RecordBatch.from_arrays([*table, *(pa.nulls(len(who), schema.field(x).type) for x in _NAMES)], schema=schema)
        order = np.lexsort((key, code, of))  # from rare to frequent
        key, of, code = key[order], of[order], code[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        first = place <= (shared - need)[of]
        left = (shared[of] - place)[first].astype(np.uint32)
        key, of, code = key[first], of[first], code[first]
        for known in (False, True):
            pick = np.flatnonzero((code == FREQUENT_CODE) == known)
            k, o, m = key[pick], of[pick], left[pick]
            # frequent n-grams are dealt out by class
            part = np.zeros(len(k), np.int64) if known else (k >> np.uint64(REST_BITS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, o, m, part = k[order], o[order], m[order], part[order]
            at = _runs(part * len(uc) + o)
            cuts = np.arange(2 if known else (1 << bits) + 1)
            ids = cuts[:-1]
            rows = _pack(np.array([int(uc[0]) >> (64 - bits)]) if known else ids, np.full(1, -1) if known else ids, np.searchsorted(part, cuts), np.searchsorted(part[at], cuts), uc[o[at]], size[o[at]].astype(np.uint32), np.diff(np.append(at, len(k))).astype(np.uint16), _packed(k, 8 if known else 5), m)
            yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, schema.field(x).type) for x in names[:3]] + rows.columns, schema=schema)

    return run


def _least_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, least): of the frequent n-grams of a task's classes the least class, in an order of signed numbers."""
    held = _Entries(8)
    for batch in batches:
        held.add(batch, lambda part: part < 0)
    if held.rows:
        uc, _, of, key, _ = held.all()
        order = np.lexsort((of, key))
        first = order[_starts(key[order])]
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array((uc[of[first]] ^ _SIGN).view(np.int64))], ["gram", "least"])


def _meetings(threshold, small, frequent):
    """(cell, class): classes that may be partners, by the least of those that meet with them."""
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, least_of = _Entries(5), _Entries(8), frequent.value
        for batch in batches:
            known.add(batch, lambda part: part < 0)
            held.add(batch, lambda part: part >= 0)
        if known.rows:
            uc, _, of, key, _ = known.all()
            yield _cells(least_of[1][np.searchsorted(least_of[0], key)], uc[of])
        if not held.rows:
            return
        uc, size, of, key, more = held.all()
        left = more.view(np.uint32).astype(np.int64)
        order = _by_gram(key, of)
        key, of, left = key[order], of[order], left[order]
        at = _starts(key)
        many = np.diff(np.append(at, len(key)))
        keep = np.repeat(many > small, many)
        for k in np.unique(many[(many > 1) & (many <= small)]).tolist():
            runs = at[many == k]
            for s in range(0, len(runs), max(1, (1 << 20) // (k * k))):
                ix = runs[s : s + max(1, (1 << 20) // (k * k)), None] + np.arange(k)
                n, m = size[of[ix]].astype(np.int64), left[ix]
                ok = np.minimum(m[:, :, None], m[:, None, :]) >= share * (n[:, :, None] + n[:, None, :]) - 1e-9
                ok[:, np.arange(k), np.arange(k)] = False
                keep[ix] = ok.any(axis=2)
        key, of = key[keep], of[keep]
        at = _starts(key)
        yield _cells(uc[np.repeat(of[at], np.diff(np.append(at, len(key))))], uc[of])

    def _cells(cell, c):
        both = np.unique(np.stack([cell, c], axis=1), axis=0) if len(c) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)], ["cell", "c"])

    return run


def _join_cells(threshold, width, listed):
    """Of each cell the links; or, where pairs aren't ``listed``, how many documents each class is linked to here, and the least class of those connected."""
    names = ["a", "b", "overlap", "jaccard"] if listed else ["c", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in B.groups(batches, "task"):
            c, n, copies = (cell.column(x).to_numpy() for x in ("c", "n", "copies"))
            block, grams = cell.column("block").to_numpy(), cell.column("grams").combine_chunks()
            sets = [_unpacked(grams[i].as_buffer(), width) for i in range(len(c))]
            here = cell.column("cell")[0].as_py()
            other = [set(v) for v in cell.column("cells").to_pylist()]
            several = np.array([len(x) > 1 for x in other])

            def allowed(x, y, block=block, here=here, other=other, several=several):
                # two blocks of a cell are compared across only, and a pair that meets in several cells counts in the least
                ok = (block[x] != block[y]) | (block.min() == block.max())
                for k in np.flatnonzero(ok & several[x] & several[y]).tolist():
                    ok[k] = min(other[x[k]] & other[y[k]]) == here
                return ok

            x, y, o = join_sets(sets, threshold, n.astype(np.int64), allowed)
            if not len(x):
                continue
            if listed:
                out = [pa.array(np.minimum(c[x], c[y])), pa.array(np.maximum(c[x], c[y])), pa.array(o), pa.array(o / (n[x] + n[y] - o))]
            else:
                links = np.bincount(x, copies[y], len(c)) + np.bincount(y, copies[x], len(c))
                has = np.flatnonzero(links)
                out = [pa.array(c[has]), pa.array(links[has].astype(np.int64)), pa.array(c[least_rows(len(c), x, y)[has]])]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


class Join:
    """The join over ``docs``: ``nodes`` (id, c) are the distinct pairs of an id and an n-gram set that has any; ``classes`` (c, first, copies) the sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, block: int = BLOCK, frequent: int = FREQUENT, part_grams: int = PART_GRAMS, small: int = SMALL):
        spark = docs.sparkSession
        self.threshold, self.block = threshold, block
        self.kind = docs.schema[id_col].dataType.simpleString()
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
        self.signed = signed = materialise(texts.mapInArrow(trimmed(_signatures(n)), f"id {self.kind}, c long, n long, frequent binary"), "signed")
        self.nodes = signed.filter("c IS NOT NULL").select("id", "c").distinct()
        self.classes = materialise(self.nodes.groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
        grams = signed.agg(F.sum("n")).first()[0] or 0
        shuffled = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(grams / part_grams))
        self.bits = min((shuffled - 1).bit_length(), 24)
        parts, drop = 1 << self.bits, np.uint64(64 - REST_BITS - self.bits)
        found = signed.filter("frequent IS NOT NULL").select("frequent").repartition(8).mapInArrow(trimmed(_merge_frequent), "frequent binary").toPandas().frequent.tolist()
        common = np.zeros(0, np.uint64)
        if found:
            u, c = _summed([tuple(np.frombuffer(x, np.uint64).reshape(2, -1)) for x in found], MOST_FREQUENT)
            common = np.unique(u[c >= frequent] >> drop)
        shared = spark.sparkContext.broadcast(common)
        spread = texts.select("text").mapInArrow(trimmed(_spread(n, self.bits, shared)), _PACKED).repartitionById(parts, "goes")
        live = spread.mapInArrow(trimmed(_shared(self.bits)), _PACKED).repartitionById(parts, "goes")
        self.left_all = left = materialise(live.mapInArrow(trimmed(_survivors(self.bits, threshold)), _LEFT), "left")
        self.left = left.filter("c IS NOT NULL").select("c", "n", "grams")
        packed = left.filter("c IS NULL").select(*_NAMES)
        holders = packed.filter("part < 0").mapInArrow(trimmed(_least_holders), "gram long, least long").groupBy("gram").agg(F.min("least").alias("least"))
        self.holders = holders.toPandas() if len(common) else None  # MOST_FREQUENT rows at most
        told = np.zeros((2, 0), np.uint64) if self.holders is None else np.stack([self.holders.gram.to_numpy(np.int64).view(np.uint64), self.holders.least.to_numpy(np.int64).view(np.uint64) ^ _SIGN])
        told = spark.sparkContext.broadcast(told[:, np.argsort(told[0])])
        meet = packed.repartitionById(parts, "goes").mapInArrow(trimmed(_meetings(threshold, small, told)), "cell long, c long")
        self.cells = materialise(meet.distinct(), "cells")

    def _joined(self, listed: bool, schema: str) -> DataFrame:
        size = materialise(self.cells.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        large = size.filter(F.col("size") > self.block)
        some = self.cells.join(size.select("cell"), "cell", "left_semi")
        mine = some.groupBy("c").agg(F.collect_list("cell").alias("cells"))
        full = mine.join(self.left, "c").join(self.classes.select("c", "copies"), "c")
        rows = full.select("c", "n", "copies", "grams", "cells", F.explode("cells").alias("cell"))
        rows = rows.join(by_size(large, large.count()), "cell", "left")
        # a large cell's blocks are by hash, and each pair of them is a task
        rows = rows.withColumn("blocks", F.expr(f"coalesce(CAST(ceil(size / {self.block}) AS INT), 1)")).withColumn("block", F.expr("CAST(pmod(xxhash64(c), blocks) AS INT)"))
        rows = rows.withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        rows = rows.withColumn("task", F.expr("concat_ws(' ', cell, least(block, other), greatest(block, other))")).drop("size", "blocks", "other")
        width = 6 if REST_BITS + self.bits <= 48 else 8
        return rows.repartition("task").sortWithinPartitions("task").mapInArrow(trimmed(_join_cells(self.threshold, width, listed)), schema)

    def pairs(self) -> DataFrame:
        """(a, b, overlap, jaccard) of the classes that are linked, a < b, each pair once."""
        return self._joined(True, "a long, b long, overlap long, jaccard double")

    def linked(self) -> DataFrame:
        """(c, links, least): of each class that isn't alone the number of other documents that any document of it is linked to, and the least id of its group."""
        out = linked(self._joined(False, "c long, links long, root long"), self.nodes, self.classes)
        discard(self.left_all, self.cells)
        return out


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_links), a row for each document.

    A document is linked to every other one whose n-gram set reaches the
    threshold with its own, copies included; n_links is their number, and
    class_id the least id of all that links connect, the document's own where
    there are none.  Rows of a null id give no row.  Null texts and texts
    without a word are linked to nothing.  Repeated rows are one document; an
    id with several texts has a row for each n-gram set of them (and one for
    those without a word), linked or not as they are, but all of one class.
    Ties have no order: all links count.  Columns other than the two named
    aren't read.  An empty table gives an empty result.
    """
    join = Join(docs, id_col, text_col, n, threshold)
    bare = join.signed.filter("id IS NOT NULL AND c IS NULL").select("id")
    return by_document(join.linked(), join.nodes, bare).withColumnRenamed("id", id_col)


def ngram_jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (c, id) of each n-gram set c, and (a, b, overlap, jaccard) of the sets that reach the threshold.

    Copies aren't expanded into pairs.  Rows of a null id or text, and texts
    without a word, are in neither.
    """
    join = Join(docs, id_col, text_col, n, threshold)
    return join.nodes.select("c", F.col("id").alias(id_col)), join.pairs()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with only the least id of each group of documents that links connect.

    All columns stay.  Rows of a null id or text, and texts without a word,
    all stay, unless their id goes for another text.  Rows of one id are one
    document: they stay or go together, repeated rows included.  An empty
    table stays empty.
    """
    join = Join(docs, id_col, text_col, n, threshold)
    groups = join.linked()
    gone = join.nodes.join(by_size(groups, groups.count()), "c").filter("id <> least").select(F.col("id").alias(id_col)).distinct()
    gone = materialise(gone, "gone")
    return docs.join(by_size(gone, gone.count()), id_col, "left_anti").select(*docs.columns)
