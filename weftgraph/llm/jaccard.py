"""Exact Jaccard join of word-shingle sets with a count-vector R-tree.

Shingles are 64-bit hashes. Two sets that reach the threshold share at least k
shingles among the first ``n - ceil(t n) + k`` of each, in any common order, so
documents are dealt out by those; shingles that very many documents have come last
in the order. k grows with n (``shared``): a document with fewer repeated shingles
in its prefix than any link needs, shared with texts of a size that a link allows, is linked with nothing and leaves. Runs of one shingle, cut
where neighbouring sizes differ too much, connect what stays to clusters: every
true link lies inside one cluster. Runs of hot shingles are salted, and what the
parts of a run cover is connected afterwards. Each cluster is joined exactly
as a unit: shingles are hashed to groups, the
counts by group are points, points are packed to boxes and those to boxes again, the sum of coordinate
minima of a point and a box's upper corner bounds every overlap in the box, then
the sum of minima of two points bounds theirs, and pairs that survive are verified
by their sets. Pairs already connected aren't looked at again, so a group of near
copies costs no list of all pairs.

Large clusters are mostly chance: their texts are read again and dealt out anew by whole
sets, rarest shingles first (``_finer``). Clusters that are still too large for a unit are dealt out by size: sizes grow by a link's ratio
from one class to the next, so links are inside a class or between neighbours, and two classes
make a unit. What is still too large is joined in three rounds: its chunks each for
itself, then one text of each component found so far, then all others against the
largest component and among themselves, without pairs that are connected already.

A pure R-tree over all documents can't prune: count vectors of unrelated
documents are all about equally far apart (see README), hence the clusters above
the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, join_hot, text_or_empty
from weftgraph.operators.components import components

WORDS = 5
PERCENT = 80
CHUNK = 1 << 18
# A shingle in one of HOT_SHARE documents or more is hot: at most HOT_SHARE times the mean set size can be.
HOT_SHARE = 1_000
BLOCK_SHINGLES = 1 << 21
UNIT_SHINGLES = 1 << 21
# Clusters of more texts than this, or of more shingles than a unit has, are dealt out anew by their whole sets.
UNIT_TEXTS = 1_000
# Bits of the filter of texts that are read again: 8 MB at any size of the input.
FILTER_BITS = 1 << 26
LEAF = 32
# The run of a hot shingle is dealt out to so many tasks, below 1 << SALT_BITS.
SALTS = 64
SALT_BITS = 8
# Texts whose 64-bit hash is another text's too: 10^11 texts have about 300.
MOST_CLASHES = 100_000

_U = np.uint64
ODD = 0x9E3779B97F4A7C15
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        up = np.concatenate([[_U(1)], np.full(CHUNK + 1, _U(ODD))])
        down = np.concatenate([[_U(1)], np.full(CHUNK + 1, _U(pow(ODD, -1, 1 << 64)))])
        self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        self.places = _mix(np.arange(1, words + 1, dtype=_U)) | _U(1)

    def _chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of at most CHUNK bytes."""
        a = np.frombuffer(data, np.uint8)
        gap = GAP[a]
        edges = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.concatenate([[_U(0)], np.cumsum((a.astype(_U) + _U(1)) * self.up[: len(a)], dtype=_U)])
        return _mix((sums[last] - sums[first]) * self.down[first] + (last - first).astype(_U)), first

    def _long(self, data: bytes) -> np.ndarray:
        """Word hashes of any text, in pieces cut between words."""
        found, at = [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            if end < len(data):
                cut = end
                while cut > at and not GAP[data[cut - 1]]:
                    cut -= 1
                if cut == at:  # one word that is longer than a piece
                    while end < len(data) and not GAP[data[end]]:
                        end += 1
                    found.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], _U))
                    at = end
                    continue
                end = cut
            found.append(self._chunk(data[at:end])[0])
            at = end
        return np.concatenate(found) if found else np.zeros(0, _U)

    def _sets(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """starts, ends: the words of each document."""
        k = self.words
        if len(hashes) >= k:
            total = sum(hashes[j : len(hashes) - k + 1 + j] * self.places[j] for j in range(k))
            grams = _mix(total)
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s >= k:
                g = np.sort(grams[s : e - k + 1])
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                out.append(g[keep])
            elif e > s:
                short = sum(int(hashes[j]) * int(self.places[j - s]) for j in range(s, e)) + e - s
                out.append(_mix(np.array([short % (1 << 64)], _U)))
            else:
                out.append(np.zeros(0, _U))
        return out

    def __call__(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, set) for each text."""
        some: list[bytes] = []
        first = size = 0

        def flush(upto: int) -> Iterator[tuple[int, np.ndarray]]:
            if some:
                hashes, at = self._chunk(b"\n".join(some))
                ends = np.cumsum([len(x) + 1 for x in some])
                last = np.searchsorted(at, ends)
                yield from zip(range(first, upto), self._sets(hashes, np.concatenate([[0], last[:-1]]), last), strict=True)

        for k, text in enumerate(texts):
            raw = text.encode().lower()  # of bytes: A-Z only
            if size + len(raw) + 1 > CHUNK:
                yield from flush(k)
                some, first, size = [], k, 0
            if len(raw) >= CHUNK:
                hashes = self._long(raw)
                yield k, self._sets(hashes, np.array([0]), np.array([len(hashes)]))[0]
                first = k + 1
            else:
                some.append(raw)
                size += len(raw) + 1
        yield from flush(first + len(some))


def shared(n):
    """Shingles that the prefixes of two linked sets have in common, the smaller of n shingles; also for columns."""
    return 1 + n // 10 if isinstance(n, int) else 1 + F.floor(n / 10)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + shared(n)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    return (x.as_py() for x in batch.column(column))  # one text in memory beside the batch


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, print, second, n), and (token, docs) of shingles frequent in a block."""
    shingles = Shingler()
    held: list[np.ndarray] = []
    size = docs = 0

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "print", "second", "n", "token", "docs"])

    def frequent() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(at, len(tokens)))
        some = counts >= max(3, docs // HOT_SHARE)
        found = tokens[at[some]].view(np.int64)
        none = pa.nulls(len(found), pa.int64())
        return rows(none, none, none, none, found, counts[some])

    for batch in batches:
        ns = np.zeros(batch.num_rows, np.int64)
        for k, s in shingles(_texts(batch, 3)):
            ns[k] = len(s)
            held.append(s)
            size += len(s)
            docs += 1
            if size >= BLOCK_SHINGLES:
                yield frequent()
                size = docs = 0
        none = pa.nulls(batch.num_rows, pa.int64())
        yield rows(batch.column(0), batch.column(1), batch.column(2), ns, none, none)
    if held:
        yield frequent()


def _marked(s: np.ndarray, tid: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set with its hot tokens last, and the salts: 0, or 1 to SALTS for hot tokens."""
    salt = np.zeros(len(s), np.int64)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        if is_hot.any():
            s = np.concatenate([s[~is_hot], s[is_hot]])
            salt[len(s) - int(is_hot.sum()) :] = 1 + tid % SALTS
    return s, salt


def _token_batches(sets: Iterable[tuple[int, np.ndarray]], hot: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
    """Batches (token, tid, ns) of the prefixes of (tid, set), or of the whole sets, of CHUNK rows and one text's more."""
    out, owners, ns = [], [], []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(ns))], names=["token", "tid", "ns"])

    for tid, s in sets:
        n = len(s)
        if not n:
            continue
        s, salt = _marked(s, tid, hot)
        if not whole:
            s, salt = s[: prefix_length(n)], salt[: prefix_length(n)]
        out.append(s)
        owners.append(np.full(len(s), tid, np.int64))
        ns.append((n << SALT_BITS) + salt)
        size += len(s)
        if size >= CHUNK:
            yield batch()
            out, owners, ns, size = [], [], [], 0
    if out:
        yield batch()


def _prefixes(hot: np.ndarray):
    """(token, tid, ns) for the prefix of each text, copies in one task once; ns is n and a salt, 0 or 1 to SALTS for hot tokens, in the last SALT_BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(), set()
        for batch in batches:
            tids, texts, kept = batch.column(0).to_pylist(), [], []
            for k, tid in enumerate(tids):
                if tid not in seen:
                    seen.add(tid)
                    kept.append(tid)
                    texts.append(batch.column(1)[k].as_py())
            yield from _token_batches(((kept[k], s) for k, s in shingles(texts)), hot, False)

    return run


def _wholes(hot: np.ndarray):
    """(token, tid, ns) as of _prefixes, for the whole sets of rows tid, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            tids = batch.column(0).to_pylist()
            yield from _token_batches(((tids[k], s) for k, s in shingles(_unpacked(batch.column(1).to_pylist()))), hot, True)

    return run


def _columns(batch: pa.RecordBatch, names: Iterable[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token, salt, n and tid: each tid once, where another tid of the token has a size that a link allows; salted rows all stay.

    Sizes are in order, so the nearest sizes are those of the rows before and after. Columns after token, tid and ns stay as they are.
    """
    held: list[np.ndarray] | None = None  # the last row: what follows decides
    near = False  # the last row's size is near enough to that of the one before

    def given(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        cols = _columns(batch, names)
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        token, tid, ns = cols[:3]
        salt = ns & ((1 << SALT_BITS) - 1)
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        fresh = np.concatenate([[True], ~(same & (tid[1:] == tid[:-1]))])
        if not fresh.all():
            cols, salt = [c[fresh] for c in cols], salt[fresh]
            token, tid, ns = cols[:3]
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        n = ns >> SALT_BITS
        close = same & (100 * n[:-1] >= PERCENT * n[1:])
        before = np.concatenate([[near], close])
        keep = (before[:-1] | close) | (salt[:-1] > 0)
        yield given([c[:-1] for c in cols], keep)
        held, near = [c[-1:] for c in cols], bool(before[-1])
    if held is not None:
        yield given(held, np.array([near or held[2][0] % (1 << SALT_BITS) > 0]))


# Rows of _chains: pairs of a token with other documents, a token's only pair, what a chain of a salted run covers.
MORE, ALONE, COVERS = 0, 1, 2


def _edge_batch(a, na, b, nb, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (a, na, b, nb, kind)], names=["a", "na", "b", "nb", "kind"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token, salt, n, tid: (a, na, b, nb, kind) from each chain's head to its members.

    A chain is a part of a run of one token and salt in which each size is at least PERCENT of
    the next. ALONE: the whole run is this one pair. COVERS, for chains of salted runs:
    head, its size, token, largest size.
    """
    state = None  # of the run that may go on: token, salt, head, last (rows), members, waiting (a pair that may be alone)
    for batch in batches:
        if not batch.num_rows:
            continue
        token, ns, tid = _columns(batch, ("token", "ns", "tid"))
        salt, n = ns & ((1 << SALT_BITS) - 1), ns >> SALT_BITS
        ahead = 0
        if state:
            rows = [state["head"]] if state["head"] == state["last"] else [state["head"], state["last"]]
            ahead = len(rows)
            token, salt = np.concatenate([[state["token"]] * ahead, token]), np.concatenate([[state["salt"]] * ahead, salt])
            tid, n = np.concatenate([[r[0] for r in rows], tid]), np.concatenate([[r[1] for r in rows], n])
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])])
        fresh = ~(same & np.concatenate([[False], (tid[1:] == tid[:-1]) & (n[1:] == n[:-1])]))
        token, salt, tid, n, same = token[fresh], salt[fresh], tid[fresh], n[fresh], same[fresh]
        index = np.arange(len(token))
        begins = ~same | np.concatenate([[True], 100 * n[:-1].astype(np.int64) < PERCENT * n[1:].astype(np.int64)])
        if ahead == 2:
            begins[1] = False  # the chain of both went on through rows given out before
        head = np.maximum.accumulate(np.where(begins, index, 0))
        run = np.cumsum(~same) - 1
        members = np.bincount(run)
        waiting = None
        if state:
            members[0] += state["members"] - ahead
            waiting = state["waiting"]
        if waiting and (members[0] > 2 or run[-1] > 0):
            yield _edge_batch(*([x] for x in waiting), [ALONE if members[0] == 2 else MORE])
            waiting = None
        pair = (~begins) & (index >= ahead)
        kind = np.where((members[run] == 2) & (salt == 0), ALONE, MORE)
        if pair[-1] and kind[-1] == ALONE:  # the last run may go on
            pair[-1] = False
            waiting = (tid[head[-1]], n[head[-1]], tid[-1], n[-1])
        at = np.flatnonzero(pair)
        if len(at):
            yield _edge_batch(tid[head[at]], n[head[at]], tid[at], n[at], kind[at])
        ends = np.flatnonzero(np.concatenate([begins[1:], [False]]) & (salt > 0))
        if len(ends):
            yield _edge_batch(tid[head[ends]], n[head[ends]], token[ends], n[ends], np.full(len(ends), COVERS))
        h = head[-1]
        state = {"token": token[-1], "salt": salt[-1], "head": (tid[h], n[h]), "last": (tid[-1], n[-1]), "members": int(members[-1]), "waiting": waiting}
    if state and state["waiting"]:
        yield _edge_batch(*([x] for x in state["waiting"]), [ALONE])
    if state and state["salt"] > 0:
        yield _edge_batch([state["head"][0]], [state["head"][1]], [state["token"]], [state["last"][1]], [COVERS])


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From COVERS rows sorted by token and least size: pairs of heads of chains whose sizes are near enough."""
    token = head = most = None
    for batch in batches:
        a, na, t, nb = (batch.column(k).to_pylist() for k in ("a", "na", "b", "nb"))
        out = []
        for k in range(batch.num_rows):
            if t[k] != token or 100 * most < PERCENT * na[k]:
                token, head, most = t[k], (a[k], na[k]), nb[k]
            else:
                if a[k] != head[0]:
                    out.append((*head, a[k], na[k], MORE))
                most = max(most, nb[k])
        if out:
            yield _edge_batch(*zip(*out, strict=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tid, and the text in compressed form for the shuffles."""
    coder = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [coder.compress(t.as_py().encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "tid", "packed"])


def _unpacked(texts: Iterable[bytes]) -> Iterator[str]:
    coder = zstandard.ZstdDecompressor()
    return (coder.decompress(t).decode() for t in texts)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, cluster, chunks, tokens) from rows with packed texts."""
    shingles = Shingler()
    for batch in batches:
        sets = [b""] * batch.num_rows
        for k, s in shingles(_unpacked(batch.column(1).to_pylist())):
            sets[k] = s.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sets, pa.binary())], names=["tid", "cluster", "chunks", "tokens"])


def _boxes(points: np.ndarray, ns: np.ndarray, order: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the tree, the leaves first: upper corners, least and most set size and largest index below each box."""
    cuts = range(0, len(order), LEAF)
    parts = [order[s : s + LEAF] for s in cuts]
    levels = [{"upper": np.stack([points[x].max(0) for x in parts]), "least": np.array([ns[x].min() for x in parts]), "most": np.array([ns[x].max() for x in parts]), "last": np.array([x.max() for x in parts])}]
    while len(levels[-1]["last"]) > LEAF:
        low = levels[-1]
        at = np.arange(0, len(low["last"]), LEAF)
        levels.append({"upper": np.maximum.reduceat(low["upper"], at), "least": np.minimum.reduceat(low["least"], at), "most": np.maximum.reduceat(low["most"], at), "last": np.maximum.reduceat(low["last"], at)})
    return levels


def join_unit(tids: list[int], sets: list[np.ndarray], labels: list[int] | None = None, sides: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(smaller tid, tid) pairs that connect exactly the linked documents of a unit: a spanning forest.

    Texts with one of ``labels`` are connected already; texts of one of ``sides`` aren't compared with each other.
    """
    same: dict[bytes, list[int]] = {}
    for tid, s in zip(tids, sets, strict=True):
        same.setdefault(s.tobytes(), []).append(tid)
    forest = [(min(g), t) for g in same.values() for t in g if t != min(g)]
    items = sorted(((len(k) // 8, min(g), k) for k, g in same.items()), key=lambda x: x[:2])
    m = len(items)
    if m < 2:
        return forest
    ns = np.array([x[0] for x in items], np.int64)
    ids = np.array([x[1] for x in items], np.int64)
    flat = np.frombuffer(b"".join(x[2] for x in items), _U)
    at = np.concatenate([[0], np.cumsum(ns)])
    _, dense = np.unique(flat, return_inverse=True)

    groups = 16
    while groups < 256 and groups * 4 < ns[m // 2]:
        groups *= 2
    owner = np.repeat(np.arange(m), ns)
    points = np.bincount(owner * groups + (flat & _U(groups - 1)).astype(np.int64), minlength=m * groups).reshape(m, groups).astype(np.int32)
    # leaves: sorted by size, in each slab by the first coordinate
    order = np.arange(m)
    slab = LEAF * LEAF
    for s in range(0, m, slab):
        part = order[s : s + slab]
        order[s : s + slab] = part[np.argsort(points[part, 0], kind="stable")]
    levels = _boxes(points, ns, order)

    place = {t: k for k, t in enumerate(tids)}
    own_place = np.array([place[t] for t in ids.tolist()])
    part = np.arange(m) if labels is None else np.unique(np.array(labels, np.int64)[own_place], return_inverse=True)[1]
    before = part.copy()
    side = None if sides is None else np.array(sides)[own_place]
    mark = np.zeros(len(flat) and int(dense.max()) + 1, bool)
    bound = lambda na, nb, minima: (100 + percent) * minima >= percent * (na + nb)
    for i in range(m):
        near = np.arange(len(levels[-1]["last"]))
        for depth in range(len(levels) - 1, -1, -1):
            box = levels[depth]
            near = near[(box["last"][near] > i) & (percent * box["least"][near] <= 100 * ns[i]) & (100 * box["most"][near] >= percent * ns[i])]
            near = near[bound(ns[i], np.maximum(box["least"][near], ns[i] * percent // 100), np.minimum(points[i], box["upper"][near]).sum(1))] if len(near) else near
            if not len(near):
                break
            size = m if depth == 0 else len(levels[depth - 1]["last"])
            near = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
            near = near[near < size]
        if not len(near):
            continue
        j = order[near]
        j = j[(j > i) & (part[j] != part[i]) & (percent * ns[j] <= 100 * ns[i])]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        j = np.sort(j[bound(ns[i], ns[j], np.minimum(points[i], points[j]).sum(1))])
        if not len(j):
            continue
        own = dense[at[i] : at[i + 1]]
        mark[own] = True
        taken = np.concatenate([dense[at[k] : at[k + 1]] for k in j.tolist()])
        begins = np.concatenate([[0], np.cumsum(ns[j])[:-1]])
        both = np.add.reduceat(mark[taken].astype(np.int64), begins)
        mark[own] = False
        linked = j[100 * both >= percent * (ns[i] + ns[j] - both)]
        if len(linked):
            joined = np.unique(np.append(part[linked], part[i]))
            part[np.isin(part, joined)] = joined[0]
    # one pair for each group that was apart before
    by = np.lexsort((ids, part))
    for members in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        _, firsts = np.unique(before[members], return_index=True)
        low = int(ids[members[0]])
        forest += [(min(low, int(t)), max(low, int(t))) for t in ids[members[firsts]] if t != low]
    return forest


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, tid, packed text or set, label, side) sorted by unit (cluster, i, j): joins each unit as soon as it is read. Null labels and sides say nothing."""
    unit, tids, sets, labels, sides = None, [], [], [], []
    shingles = None

    def done() -> pa.RecordBatch:
        if shingles:
            for k, found in shingles(_unpacked(list(sets))):
                sets[k] = found
        pairs = join_unit(tids, sets, None if None in labels else labels, None if None in sides else sides)
        made = list(zip(*pairs, strict=True)) if pairs else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["a", "b"])

    for batch in batches:
        if batch.schema.field(4).name == "packed" and not shingles:
            shingles = Shingler()
        c, i, j, t, s, g, w = (batch.column(k).to_pylist() for k in range(7))
        for k in range(batch.num_rows):
            if (c[k], i[k], j[k]) != unit:
                if len(tids) > 1:
                    yield done()
                unit, tids, sets, labels, sides = (c[k], i[k], j[k]), [], [], [], []
            if not tids or tids[-1] != t[k]:  # copies of a text follow each other
                tids.append(t[k])
                sets.append(s[k] if shingles else np.frombuffer(s[k], _U))
                labels.append(g[k])
                sides.append(w[k])
    if len(tids) > 1:
        yield done()


def _joined(rows: DataFrame, what: str = "tokens", label: str = "cast(null as bigint)", side: str = "cast(null as int)") -> DataFrame:
    """Links (a, b) found in the units of rows cluster, i, j, tid and a text (packed) or set (tokens)."""
    rows = rows.selectExpr("cluster", "i", "j", "tid", what, f"{label} as label", f"{side} as side")
    units = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "tid")
    return units.mapInArrow(_units, "a bigint, b bigint")


TOKENS = "token bigint, tid bigint, ns bigint"


def _clusters(tokens: DataFrame) -> DataFrame:
    """tid, n, cluster of texts that may be linked, from their prefixes (TOKENS): every link is inside one cluster."""
    salt = F.expr(f"ns & {(1 << SALT_BITS) - 1}")
    runs = tokens.repartition("token", salt).sortWithinPartitions("token", salt, "ns", "tid")
    runs = Staged(runs.mapInArrow(_repeated, TOKENS), "jaccard-tokens").df
    least_n = F.ceil(F.shiftright("ns", SALT_BITS) * PERCENT / 100)  # of a linked partner
    kept = runs.withColumn("c", F.count("*").over(Window.partitionBy("tid"))).filter(F.col("c") >= shared(least_n)).select("token", "tid", "ns")
    runs = kept.repartition("token", salt).sortWithinPartitions("token", salt, "ns", "tid")
    edges = runs.mapInArrow(_chains, "a bigint, na bigint, b bigint, nb bigint, kind bigint")
    summed = edges.groupBy("a", "na", "b", "nb", (F.col("kind") == COVERS).alias("covers")).agg(F.sum((F.col("kind") == ALONE).cast("int")).alias("alone"), F.sum((F.col("kind") == MORE).cast("int")).alias("more"))
    summed = Staged(summed, "jaccard-chains").df
    covers, summed = summed.filter("covers"), summed.filter("not covers").drop("covers")
    bridges = covers.select("a", "na", "b", "nb").repartition("b").sortWithinPartitions("b", "na", "a").mapInArrow(_bridges, "a bigint, na bigint, b bigint, nb bigint, kind bigint").drop("kind")
    # a pair seen only alone has that many common tokens, but for runs of three and more
    ends = summed.filter("more > 0")
    others = ends.select(F.col("a").alias("t"), "more").unionByName(ends.select(F.col("b").alias("t"), "more")).groupBy("t").agg(F.sum("more").alias("others"))
    others = Staged(others, "jaccard-others").df
    joined = join_hot(summed, others.select(F.col("t").alias("a"), F.col("others").alias("oa")), "a", summed.count())
    joined = joined.join(others.select(F.col("t").alias("b"), F.col("others").alias("ob")).hint("merge"), "b", "left")
    common = F.col("alone") + F.least(F.coalesce("oa", F.lit(0)), F.coalesce("ob", F.lit(0)))
    coarse = joined.filter((F.col("more") > 0) | (common >= shared(F.least("na", "nb")))).select("a", "na", "b", "nb")
    coarse = Staged(coarse.unionByName(bridges), "jaccard-coarse").df
    sizes = coarse.select(F.col("a").alias("tid"), F.col("na").alias("n")).unionByName(coarse.select(F.col("b").alias("tid"), F.col("nb").alias("n"))).distinct()
    cluster = components(coarse.select("a", "b")).withColumnsRenamed({"node": "tid", "component": "cluster"})
    member = sizes.join(cluster.hint("merge"), "tid", "left").select("tid", "n", F.coalesce("cluster", "tid").alias("cluster"))
    return Staged(member, "jaccard-clusters").df


def _finer(member: DataFrame, texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Rows tid, n, cluster with large clusters dealt out anew by the whole sets of their texts: every link stays inside one cluster.

    ``texts``: rows tid, packed. Clusters grow with the table by chance: prefixes that repeat
    in part connect texts of which most occurs nowhere else. A set of n shingles has
    at least PERCENT of n in common with any linked one, so a text with fewer repeated
    shingles leaves. Of the c repeated shingles of a text that stays the rarest
    c - ceil(PERCENT n) + k make the new prefix, which shares k with that of any linked text.
    """
    total = member.groupBy("cluster").agg(F.sum("n").alias("all"), F.count("*").alias("texts"))
    large = Staged(total.filter((F.col("all") > UNIT_SHINGLES) | (F.col("texts") > UNIT_TEXTS)).select("cluster"), "jaccard-large").df
    if large.isEmpty():
        return member
    # one name for more than UNIT_TEXTS texts or UNIT_SHINGLES shingles
    chosen = Staged(member.join(F.broadcast(large), "cluster", "left_semi").select("tid"), "jaccard-chosen").df
    salt, n = F.expr(f"ns & {(1 << SALT_BITS) - 1}"), F.shiftright("ns", SALT_BITS)
    tokens = texts.join(chosen.hint("merge"), "tid", "left_semi").select("tid", "packed").mapInArrow(_wholes(hot), TOKENS)
    runs = tokens.repartition("token", salt).sortWithinPartitions("token", salt, "ns", "tid")
    # one order for all texts: by the number of rows of a shingle, hot ones last
    runs = runs.withColumn("rows", F.when(salt > 0, F.lit(1 << 62)).otherwise(F.count("*").over(Window.partitionBy("token", salt))))
    of_text = Window.partitionBy("tid")
    runs = runs.mapInArrow(_repeated, TOKENS + ", rows bigint")
    runs = runs.withColumn("c", F.count("*").over(of_text)).withColumn("place", F.row_number().over(of_text.orderBy("rows", "token")))
    common = F.ceil(n * PERCENT / 100)  # with any linked partner
    prefix = runs.filter((F.col("c") >= common) & (F.col("place") <= F.col("c") - common + shared(n))).select("token", "tid", "ns")
    rest = member.join(F.broadcast(large), "cluster", "left_anti").select("tid", "n", "cluster")
    return rest.unionByName(_clusters(prefix))


def _dealt(member: DataFrame) -> DataFrame:
    """tid, cluster, part, chunks from rows tid, n, cluster: the units that a text is in, and in how many chunks a unit is too large.

    Clusters of up to UNIT_SHINGLES are one unit, part 0. A text of a larger one is in the
    units of its size class and of the class below.
    """
    total = Staged(member.groupBy("cluster").agg(F.sum("n").alias("all")), "jaccard-totals").df
    named = Staged(join_hot(member, total, "cluster", member.count()), "jaccard-sized").df
    whole = named.filter(F.col("all") <= UNIT_SHINGLES).select("tid", "cluster", F.lit(0).alias("part"), F.lit(1).alias("chunks"))
    # a little below the ratio, so that rounding of logarithms parts no sizes that may be linked
    width = math.log(100 / PERCENT) * (1 + 1e-9)
    level = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    large = named.filter(F.col("all") > UNIT_SHINGLES).withColumn("part", F.explode(F.array(level + 1, level)))
    large = Staged(large.select("tid", "n", "cluster", "part"), "jaccard-parts").df
    sizes = large.groupBy("cluster", "part").agg(F.ceil(F.sum("n") / (UNIT_SHINGLES // 2)).cast("int").alias("chunks"))
    chunks = F.when(F.col("chunks") <= 2, 1).otherwise(F.col("chunks")).alias("chunks")
    # as many rows as a cluster has size classes
    return whole.unionByName(large.join(F.broadcast(sizes), ["cluster", "part"]).select("tid", "cluster", "part", chunks))


def _rounds(sets: DataFrame) -> DataFrame:
    """Links of clusters that are cut into chunks: rows tid, cluster, chunks, tokens."""
    sets = Staged(sets.withColumn("n", (F.octet_length("tokens") / 8).cast("bigint")), "jaccard-sets").df

    def dealt(column: str, chunks) -> DataFrame:
        return F.pmod(F.xxhash64(F.lit(column), "tid"), chunks).cast("int")

    unit = F.lit(UNIT_SHINGLES // 2)
    one = Staged(_joined(sets.withColumn("i", dealt("one", F.col("chunks"))).withColumn("j", F.col("i"))), "jaccard-links").df
    label = components(one).withColumnsRenamed({"node": "l_tid", "component": "label"})
    # a component's label is one of its texts
    texts = sets.join(label, sets["tid"] == label["l_tid"], "left").filter("label is null").drop("l_tid", "label")
    size = texts.groupBy("cluster").agg(F.ceil(F.sum("n") / unit).alias("parts"))
    two = Staged(_joined(texts.join(size, "cluster").withColumn("i", dealt("two", F.col("parts"))).withColumn("j", F.col("i"))), "jaccard-links").df
    links_ = one.unionByName(two)
    label = components(links_).withColumnsRenamed({"node": "l_tid", "component": "label"})
    named = sets.join(label, sets["tid"] == label["l_tid"], "left").withColumn("label", F.coalesce("label", "tid")).drop("l_tid", "chunks")
    named = Staged(named, "jaccard-sets").df
    # the largest component of a cluster is only compared with the others
    total = named.groupBy("cluster", "label").agg(F.sum("n").alias("n"))
    most = total.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    most = most.select("cluster", F.col("most.label").alias("main"), F.ceil(F.col("most.n") / unit).cast("int").alias("g"), F.ceil((F.col("all") - F.col("most.n")) / unit).cast("int").alias("r"))
    rows = named.join(most, "cluster").filter("r > 0")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    mains = rows.filter("label = main").withColumn("i", -1 - dealt("main", F.col("g"))).withColumn("j", F.explode(up_to(F.col("r")))).withColumn("side", F.lit(1))
    rest = rows.filter("label <> main").withColumn("own", dealt("rest", F.col("r")))
    across = rest.withColumn("i", F.explode(up_to(F.col("g")))).withColumn("i", -1 - F.col("i")).withColumn("j", F.col("own")).withColumn("side", F.lit(0))
    columns = ["cluster", "i", "j", "tid", "tokens", "label", "side"]
    three = _joined(mains.select(*columns).unionByName(across.select(*columns)), "tokens", "label", "side")
    among = rest.withColumn("other", F.explode(up_to(F.col("r")))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return links_.unionByName(three).unionByName(_joined(among, "tokens", "label"))


def _maybe(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose tid and doc may be in ``ids``: a bitmap of FILTER_BITS hash values, so most others never meet the join's shuffle."""
    key = F.pmod(F.xxhash64("tid", "doc"), F.lit(FILTER_BITS))
    bits = ids.select(key.alias("k")).groupBy(F.expr("bitmap_bucket_number(k)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("bits"))
    place = F.expr("bitmap_bit_position(k)")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.expr("bitmap_bucket_number(k)") == F.col("bucket")
    joined = df.withColumn("k", key).join(F.broadcast(bits), on)  # FILTER_BITS / 8 bytes at most
    return joined.filter((byte.bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int"))) != 0).select(*df.columns)


def _prints(body):
    """Two hashes of a text, of different seeds: together 128 bits."""
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)


def _clashes(rows: DataFrame) -> list[int]:
    """First hashes that different texts of ``rows`` have; by chance a few at any size that can be stored."""
    found = rows.groupBy("print").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high")
    clashes = [r["print"] for r in found.select("print").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many different texts have equal hashes")
    return clashes


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print, second (hashes of the text), n_shingles, label for every row.

    Rows with one label are connected by links; label is null without shingles.
    A text is known by its first hash, or by its second where different texts share the first.
    """
    body = text_or_empty(docs, text)
    first, second = _prints(body)
    base = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), first.alias("print"), second.alias("second"), body.alias("body"))
    seen = Staged(base.mapInArrow(_counted, "doc_id bigint, print bigint, second bigint, n bigint, token bigint, docs bigint"), "jaccard-rows").df
    rows = seen.filter("token is null").select("doc_id", "print", "second", "n")
    clashes = _clashes(rows)
    tid = F.when(F.col("print").isin(clashes), F.col("second")).otherwise(F.col("print")) if clashes else F.col("print")
    doc = F.coalesce("doc_id", F.lit(-1).cast("bigint")).alias("doc")
    rows, base = rows.withColumn("tid", tid), base.select(doc, tid.alias("tid"), "body")
    n_docs = rows.count()
    frequent = seen.filter("token is not null").groupBy("token").agg(F.sum("docs").alias("docs"))
    least = max(16, n_docs // HOT_SHARE)
    # bounded: the sum of all set sizes divided by least
    hot = np.sort(np.array([r[0] for r in frequent.filter(F.col("docs") >= least).select("token").collect()], np.int64).view(_U))

    member = _clusters(base.select("tid", "body").mapInArrow(_prefixes(hot), TOKENS))
    # of the copies of a text one is read again
    copy = rows.groupBy("tid").agg(F.min("doc_id").alias("doc")).fillna(-1, ["doc"])
    wanted = Staged(member.select("tid").join(copy.hint("merge"), "tid"), "jaccard-wanted").df
    texts = _maybe(base, wanted).select("doc", "tid", "body").mapInArrow(_packed, "doc bigint, tid bigint, packed binary")
    texts = Staged(texts.join(wanted.hint("merge"), ["tid", "doc"]).select("tid", "packed"), "jaccard-texts").df
    member = Staged(_dealt(_finer(member, texts, hot)), "jaccard-members").df
    some = texts.join(member.hint("merge"), "tid").select("tid", "packed", "cluster", "part", "chunks")
    forest = _joined(some.filter("chunks = 1").withColumn("i", F.col("part")).withColumn("j", F.lit(0)), "packed")
    if not member.filter("chunks > 1").isEmpty():
        large = some.filter("chunks > 1").withColumn("cluster", F.xxhash64("cluster", "part")).select("tid", "packed", "cluster", "chunks")
        forest = forest.unionByName(_rounds(large.mapInArrow(_set_rows, "tid bigint, cluster bigint, chunks int, tokens binary")))
    forest = Staged(forest, "jaccard-links").df
    label = Staged(components(forest).withColumnsRenamed({"node": "tid", "component": "label"}), "jaccard-groups").df
    out = join_hot(rows, label, "tid", n_docs)
    return out.select("doc_id", "print", "second", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "tid")).alias("label"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Sets have five-word shingles (a shorter text as a whole), links need a Jaccard
    similarity of 80 in 100. component_id is the smallest doc_id reachable. A null
    or empty text, or one without words, has 0 shingles and is linked with
    nothing, not even with its like. Equal texts are linked; repeated rows stay.
    Null ids are passed over when the smallest is sought. Other columns don't matter.
    """
    rows = Staged(links(docs, doc_id, text), "jaccard-labels").df
    least = Staged(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "jaccard-least").df
    joined = join_hot(rows, least, "label", rows.count())
    return joined.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one text of each group of linked rows: that of the smallest doc_id.

    Rows without shingles all stay, as do rows repeated in id and text.
    """
    rows = Staged(links(docs, doc_id, text), "jaccard-labels").df
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("print"), F.col("second"))).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("__w_id"), F.col("first.print").alias("__w_print"), F.col("first.second").alias("__w_second"))
    stay = stay.unionByName(rows.filter("label is null").select(F.col("doc_id").alias("__w_id"), F.col("print").alias("__w_print"), F.col("second").alias("__w_second")).distinct())
    one, two = _prints(text_or_empty(docs, text))
    on = docs[doc_id].eqNullSafe(stay["__w_id"]) & (one == stay["__w_print"]) & (two == stay["__w_second"])
    return docs.join(stay.hint("merge"), on, "left_semi")
