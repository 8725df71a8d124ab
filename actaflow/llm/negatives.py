"""Hard-negative mining by dual-tree search.

Two trees, one over the anchors and one over all vectors, are searched against each other.
A tree has three storeys.  Its top is a tree of hyperplanes, fitted on a bounded sample,
that orders all rows by label and place; runs of rows in that order are its blocks, each
with the bounds of what it holds; inside a block, halves of halves down to leaves have
bounds of their own.  Two nodes' boxes and balls give an interval that holds every inner
product between them.  Whatever lies outside of what all anchors of a node still want is
pruned for the whole node at once: for groups of anchor blocks, for blocks, and for nodes
inside two blocks; what is left are pairs of leaves, scored exactly.

What an anchor wants is a band of scores and the k-th best in it so far.  The first round
opens the most promising blocks of each anchor block; what it finds raises the k-th best,
and the second round opens whatever may still beat that.  Positives are searched among the
rows of the anchor's label, negatives among the others in the band that each positive sets.

The tables that move are blocks of a bounded number of rows, so a label or a place that
holds a third of all rows is as many blocks as it needs, and an anchor's finds are cut to
the k best of each block before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

#: Rows that the hyperplanes are fitted on, and their depth.
SAMPLE, DEPTH = 4096, 6
#: Rows of a block and of a leaf: of candidates, of anchors.
BLOCK, ANCHOR_BLOCK = 2048, 256
LEAF, ANCHOR_LEAF = 256, 32
#: Candidates at least, in their blocks, that the first round opens for an anchor block.
SEEDS = 4096
#: Parts in which the bounds of a group of anchor blocks meet those of candidate blocks.
SALTS = 8
#: Components are held between -LARGEST and LARGEST.
LARGEST = 1 << 52
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_GROUPS = 4


# -- the order of the rows ------------------------------------------------------------


class Planes(NamedTuple):
    """A binary tree of hyperplanes in heap order; a row's place is the number of its leaf."""

    directions: np.ndarray
    cuts: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        dims = self.directions.shape[1]
        x = x[:, :dims] if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.cuts) + 1))):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.directions[node]) > self.cuts[node])
        return node - len(self.cuts)


def fit_planes(sample: np.ndarray, depth: int = DEPTH) -> Planes:
    """Splits at the median along the direction of the largest spread."""
    nodes = (1 << depth) - 1
    directions, cuts = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
    members = {0: np.arange(len(sample))}
    for node in range(nodes):
        own = members.pop(node, np.empty(0, int))
        if len(own) < 2:
            continue
        x = sample[own] - sample[own].mean(0)
        d = x[np.argmax((x**2).sum(1))].copy()
        for _ in range(8):
            norm = np.linalg.norm(d)
            if not norm:
                break
            d = x.T @ (x @ (d / norm))
        norm = np.linalg.norm(d)
        directions[node] = d / norm if norm else d
        along = sample[own] @ directions[node]
        cuts[node] = np.median(along)
        members[2 * node + 1], members[2 * node + 2] = own[along <= cuts[node]], own[along > cuts[node]]
    return Planes(directions, cuts)


def _rows_of(column: pa.ListArray) -> np.ndarray:
    """Vectors of a column side by side; shorter ones are filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, dims = column.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), flat.dtype)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def ordered(rows: DataFrame, planes: Planes) -> DataFrame:
    """The rows with ``place``, dealt and sorted by label, place and id."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = planes.place(_rows_of(batch.column(2)).astype(np.float64)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["vec_id", "label", "vector", "wants", "place"])

    wants = "wants array<struct<key:long,low:long,high:long>>"
    placed = rows.select("vec_id", "label", "vector", "wants").mapInArrow(place, f"vec_id long, label int, vector array<long>, {wants}, place int")
    return placed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")


# -- blocks ---------------------------------------------------------------------------


def halves(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which each half of a stretch is one side of a split."""
    order = np.arange(len(x))
    stack = [(0, len(x))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            continue
        own = order[a:b]
        spread = x[own].max(0) - x[own].min(0) if x.shape[1] else np.zeros(1)
        middle = (b - a) // 2
        if x.shape[1]:
            order[a:b] = own[np.argpartition(x[own, int(np.argmax(spread))], middle)]
        stack += ((a, a + middle), (a + middle, b))
    return order


class Bounds(NamedTuple):
    """Boxes and balls of nodes, one a row."""

    low: np.ndarray
    high: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    def at(self, i: np.ndarray) -> Bounds:
        return Bounds(*(x[i] for x in self))


def bounds(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Bounds:
    low, high, center, radius = [], [], [], []
    for a, b in zip(starts, ends):
        own = x[a:b]
        middle = own.mean(0)
        low.append(own.min(0)), high.append(own.max(0)), center.append(middle), radius.append(np.sqrt(((own - middle) ** 2).sum(1)).max())
    return Bounds(np.array(low), np.array(high), np.array(center), np.array(radius))


def _wide(b: Bounds, dims: int) -> Bounds:
    more = ((0, 0), (0, dims - b.low.shape[1]))
    return Bounds(np.pad(b.low, more), np.pad(b.high, more), np.pad(b.center, more), b.radius)


def intervals(a: Bounds, b: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, what no inner product of the two nodes' members is below or above.  The
    slack covers the rounding of these sums."""
    dims = max(a.low.shape[1], b.low.shape[1])
    a, b = _wide(a, dims), _wide(b, dims)
    corners = np.stack([a.low * b.low, a.low * b.high, a.high * b.low, a.high * b.high])
    least, most = corners.min(0).sum(1), corners.max(0).sum(1)
    size = np.abs(corners).max(0).sum(1)
    middle = (a.center * b.center).sum(1)
    na, nb = np.sqrt((a.center**2).sum(1)), np.sqrt((b.center**2).sum(1))
    reach = na * b.radius + nb * a.radius + a.radius * b.radius
    slack = 1 + 1e-9 * (size + np.abs(middle) + reach)
    return np.maximum(least, middle - reach) - slack, np.minimum(most, middle + reach) + slack


BLOCK_SCHEMA = (
    "block long, n int, dims int, label_low int, label_high int, place int, need double, most double, "
    "bounds binary, ids binary, labels binary, vectors binary, wants binary"
)
_BLOCK_KINDS = [pa.int64(), *[pa.int32()] * 5, *[pa.float64()] * 2, *[pa.binary()] * 5]
_BLOCK_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def _pack(x: np.ndarray) -> bytes:
    """Vectors as the narrowest integers that hold them, behind a byte that says how wide they are."""
    most = int(np.abs(x).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[raw[0]], offset=1)
    return x.reshape(n, len(x) // n).astype(np.int64)


#: For each want of a block: its anchor's number in the block, key, lowest and highest score, and k-th best so far.
_WANT = np.dtype([("anchor", np.int64), ("key", np.int64), ("low", np.int64), ("high", np.int64), ("best", np.int64)])


def _block_row(number: int, ids: np.ndarray, labels: np.ndarray, places: np.ndarray, x: np.ndarray, wants: list | None, leaf: int) -> tuple:
    order = halves(x, leaf)
    ids, labels, x = ids[order], labels[order], x[order]
    whole = bounds(x.astype(np.float64), [0], [len(x)])
    flat = [(k, w["key"], w["low"], w["high"], _LEAST) for k, i in enumerate(order) for w in (wants[i] or [])] if wants else []
    wanted = np.array(flat, _WANT)
    need, most = (float(wanted["low"].min()), float(wanted["high"].max())) if len(wanted) else (np.inf, -np.inf)
    kept = np.concatenate([whole.low[0], whole.high[0], whole.center[0], whole.radius]).tobytes()
    return number, len(ids), x.shape[1], int(labels.min()), int(labels.max()), int(places[0]), need, most, kept, ids.tobytes(), labels.tobytes(), _pack(x), wanted.tobytes()


def cut_blocks(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """Runs of at most ``size`` of the ordered rows; a label of many rows has blocks of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal number
            columns = list(zip(*held))
            x = _rows_of(pa.array(columns[2], pa.list_(pa.int64())))
            out = _block_row(number, np.array(columns[0], np.int64), np.array(columns[1], np.int32), np.array(columns[4]), x, columns[3], leaf)
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, _BLOCK_KINDS)], names=_BLOCK_NAMES)

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) if i == 2 else batch.column(i).to_pylist() for i in range(5)]
            for new in zip(*columns):
                if held and (len(held) == size or new[1] != held[-1][1] and len(held) >= size // 8):
                    yield row()
                held.append(new)
        if held:
            yield row()

    return checkpoint(rows.mapInArrow(cut, BLOCK_SCHEMA))


# -- which blocks meet ----------------------------------------------------------------


def _bounds_of(raws: list[bytes], dims: list[int]) -> Bounds:
    """Bounds of blocks from their packed form."""
    wide = max(dims, default=0)
    out = Bounds(np.zeros((len(raws), wide)), np.zeros((len(raws), wide)), np.zeros((len(raws), wide)), np.zeros(len(raws)))
    for i, (raw, d) in enumerate(zip(raws, dims)):
        x = np.frombuffer(raw)
        out.low[i, :d], out.high[i, :d], out.center[i, :d], out.radius[i] = x[:d], x[d : 2 * d], x[2 * d : 3 * d], x[3 * d]
    return out


def _may_meet(same: bool, a_low, a_high, c_low, c_high):
    """Whether nodes of these labels have members of one label (or, if not ``same``, of two)."""
    if same:
        return (a_low <= c_high) & (c_low <= a_high)
    return (a_low != a_high) | (c_low != c_high) | (a_low != c_low)


_STATS = ("block", "n", "dims", "label_low", "label_high", "need", "most", "bounds")
_GROUP_SCHEMA = "grp int, dims int, label_low int, label_high int, need double, most double, bounds binary"


def _merged(table: pa.Table) -> pa.Table:
    """One group of anchor blocks as one node."""
    d = table.to_pydict()
    b, dims = _bounds_of(d["bounds"], d["dims"]), max(d["dims"])
    low, high = b.low.min(0), b.high.max(0)
    center = (low + high) / 2
    kept = np.concatenate([low, high, center, [np.sqrt(((high - center) ** 2).sum())]]).tobytes()
    values = d["grp"][0], dims, min(d["label_low"]), max(d["label_high"]), min(d["need"]), max(d["most"]), kept
    kinds = (*[pa.int32()] * 4, *[pa.float64()] * 2, pa.binary())
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _GROUP_SCHEMA.split(", ")])


def _merge_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, pa.Table] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for group in set(table.column("grp").to_pylist()):
            own = table.filter(pa.compute.equal(table.column("grp"), group))
            held[group] = _merged(pa.concat_tables([held[group], own]) if group in held else own)
    for table in held.values():
        yield from table.to_batches()


def meeting_blocks(anchors: DataFrame, candidates: DataFrame, same: bool) -> DataFrame:
    """(ablock, cblock, rows, upper): the pairs of blocks whose interval touches what the anchors want.

    At most 64 * _GROUPS groups of anchor blocks, by place and label, are nodes that every
    candidate block is held against at once; only blocks of groups that aren't pruned meet."""
    group = (F.col("place") * _GROUPS + F.pmod("label_low", F.lit(_GROUPS))).cast("int")
    stats = anchors.filter("most >= need").select(group.alias("grp"), *_STATS)
    tops = stats.drop("block", "n").mapInArrow(_merge_in_task, _GROUP_SCHEMA).groupBy("grp").applyInArrow(_merged, _GROUP_SCHEMA).collect()
    groups = np.array([r.grp for r in tops], np.int32)
    nodes = _bounds_of([bytes(r.bounds) for r in tops], [r.dims for r in tops])
    low, high, need, most = (np.array([r[c] for r in tops]) for c in ("label_low", "label_high", "need", "most"))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            d = table.to_pydict()
            own = _bounds_of(d["bounds"], d["dims"])
            take, to = [], []
            for i in range(batch.num_rows):
                least, greatest = intervals(nodes, own.at(np.full(len(groups), i)))
                hit = np.flatnonzero((greatest >= need) & (least <= most) & _may_meet(same, low, high, d["label_low"][i], d["label_high"][i]))
                take += [i] * len(hit)
                to += groups[hit].tolist()
            out = table.take(pa.array(take, pa.int64())).append_column("grp", pa.array(to, pa.int32()))
            yield from out.combine_chunks().to_batches()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pa.Table.from_batches([batch]).to_pydict()
            a, c = _bounds_of(d["bounds"], d["dims"]), _bounds_of(d["c_bounds"], d["c_dims"])
            least, greatest = intervals(a, c)
            ok = (greatest >= np.array(d["need"])) & (least <= np.array(d["most"]))
            ok &= _may_meet(same, *(np.array(d[k]) for k in ("label_low", "label_high", "c_label_low", "c_label_high")))
            hit = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(d["block"], np.int64)[hit]), pa.array(np.array(d["c_block"], np.int64)[hit]), pa.array(np.array(d["c_n"], np.int64)[hit]), pa.array(greatest[hit])], names=["ablock", "cblock", "rows", "upper"])

    own = [c for c in _STATS if c not in ("need", "most")]
    kinds = "block long, n int, dims int, label_low int, label_high int, bounds binary, grp int"
    open_nodes = candidates.select(*own).mapInArrow(descend, kinds).select("grp", F.pmod("block", F.lit(SALTS)).alias("salt"), *[F.col(c).alias(f"c_{c}") for c in own])
    salted = stats.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    joined = salted.join(open_nodes, ["grp", "salt"])
    return joined.select("block", "dims", "label_low", "label_high", "need", "most", "bounds", "c_block", "c_n", "c_dims", "c_label_low", "c_label_high", "c_bounds").mapInArrow(pairs, "ablock long, cblock long, rows long, upper double")


# -- two blocks -----------------------------------------------------------------------


class LocalTree:
    """Halves of halves of a block in its order, level by level down to the leaves."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        spans = [(0, len(x))]
        self.levels: list[tuple[np.ndarray, np.ndarray, Bounds, np.ndarray, np.ndarray]] = []
        self.children: list[np.ndarray] = []  # of each level: first child in the next one, and how many
        values = x.astype(np.float64)
        while True:
            starts, ends = np.array(spans).T
            self.levels.append((starts, ends, bounds(values, starts, ends), np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)))
            if all(b - a <= leaf for a, b in spans):
                break
            below, children = [], []
            for a, b in spans:
                middle = a + (b - a) // 2
                parts = [(a, b)] if b - a <= leaf else [(a, middle), (middle, b)]
                children.append((len(below), len(parts)))
                below += parts
            self.children.append(np.array(children))
            spans = below


class Finds:
    """The k best finds of each want of a block, best first, ties by id."""

    def __init__(self, wants: np.ndarray, k: int):
        self.wants, self.k = wants, k
        self.best = np.maximum(wants["low"], wants["best"])
        self.row, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, row))  # ~x falls where x rises, without overflow
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        nth = np.arange(len(row)) - first
        keep = nth < self.k
        last = nth == self.k - 1
        self.best[row[last]] = np.maximum(self.best[row[last]], score[last])
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held in the range of a long."""
    d = min(a.shape[1], c.shape[1])
    a, c = a[:, :d], c[:, :d]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, d)
    if most < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ c.T
    return np.array([[min(max(int(v), _LEAST), _MOST) for v in row] for row in a.astype(object) @ c.astype(object).T], np.int64).reshape(len(a), len(c))


def search_blocks(a_x, a_ids, a_labels, wants, c_x, c_ids, c_labels, same: bool, k: int, count: dict | None = None) -> Finds:
    """The finds of two blocks: pairs of nodes go down both trees together, level by level,
    and those outside of what their anchors want go; leaves meet in the order of their bounds."""
    finds = Finds(wants, k)
    a_tree, c_tree = LocalTree(a_x, a_labels, ANCHOR_LEAF), LocalTree(c_x, c_labels, LEAF)
    first = np.searchsorted(wants["anchor"], np.arange(len(a_ids) + 1))  # of each anchor, its first want
    ia, ic = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = max(len(a_tree.levels), len(c_tree.levels))

    def needs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(finds.best[first[a] : first[b]].min(initial=_MOST), wants["high"][first[a] : first[b]].max(initial=_LEAST)) for a, b in zip(starts, ends)]
        need, most = np.array(pairs, np.int64).reshape(-1, 2).T
        return need, most

    def expand(tree: LocalTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes, and which of the nodes each one is of."""
        if level >= len(tree.children):
            return nodes, np.arange(len(nodes))
        at, n = tree.children[level][nodes].T
        of = np.repeat(np.arange(len(nodes)), n)
        return at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)), of

    for level in range(depth):
        a_start, a_end, a_bounds, a_low, a_high = a_tree.levels[min(level, len(a_tree.levels) - 1)]
        c_start, c_end, c_bounds, c_low, c_high = c_tree.levels[min(level, len(c_tree.levels) - 1)]
        need, most = needs(a_start, a_end)
        least, greatest = intervals(a_bounds.at(ia), c_bounds.at(ic))
        keep = (greatest >= need[ia]) & (least <= most[ia]) & (need[ia] <= most[ia]) & _may_meet(same, a_low[ia], a_high[ia], c_low[ic], c_high[ic])
        if count is not None:
            count["pruned"] = count.get("pruned", 0) + int((~keep).sum())
        ia, ic, greatest = ia[keep], ic[keep], greatest[keep]
        if level + 1 < depth:
            new_a, of = expand(a_tree, level, ia)
            ic, of2 = expand(c_tree, level, ic[of])
            ia = new_a[of2]
    for j in np.argsort(-greatest, kind="stable"):
        a0, a1, c0, c1 = a_start[ia[j]], a_end[ia[j]], c_start[ic[j]], c_end[ic[j]]
        rows = np.arange(first[a0], first[a1])
        if greatest[j] < finds.best[rows].min(initial=_MOST):
            if count is not None:
                count["pruned"] = count.get("pruned", 0) + 1
            continue
        if count is not None:
            count["scored"] = count.get("scored", 0) + 1
        anchor = wants["anchor"][rows]
        scores = _products(a_x[a0:a1], c_x[c0:c1])[anchor - a0]
        ok = (scores >= finds.best[rows][:, None]) & (scores <= wants["high"][rows][:, None])
        ok &= (a_labels[anchor][:, None] == c_labels[c0:c1]) == same
        if same:
            ok &= a_ids[anchor][:, None] != c_ids[c0:c1]
        at, col = np.nonzero(ok)
        if len(at):
            finds.add(rows[at], scores[at, col], c_ids[c0:c1][col])
    return finds


_FOUND = "ablock long, want int, anchor_id long, key long, score long, found_id long"


def _search(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """What pairs of blocks find: for each want at most its k best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a_ids, c_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                wants = np.frombuffer(r["wants"], _WANT)
                found = search_blocks(
                    _unpack(r["vectors"], r["n"]), a_ids, np.frombuffer(r["labels"], np.int32), wants,
                    _unpack(r["c_vectors"], r["c_n"]), c_ids, np.frombuffer(r["c_labels"], np.int32), same, k,
                )
                columns = (np.full(len(found.row), r["ablock"]), found.row.astype(np.int32), a_ids[wants["anchor"][found.row]], wants["key"][found.row], found.score, found.id)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])

    a = anchors.select(F.col("block").alias("ablock"), "n", "ids", "labels", "vectors", "wants")
    c = candidates.select(F.col("block").alias("cblock"), *[F.col(x).alias(f"c_{x}") for x in ("n", "ids", "labels", "vectors")])
    return pairs.select("ablock", "cblock").join(a, "ablock").join(c, "cblock").drop("cblock").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("ablock", "want").orderBy(F.desc("score"), "found_id")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)


def _raised(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Anchor blocks whose wants know the k-th best found so far; a block has ANCHOR_BLOCK anchors at most."""
    thresholds = found.filter(F.col("nth") == k).groupBy("ablock").agg(F.collect_list(F.struct("want", "score")).alias("reached"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                wants = np.frombuffer(r["wants"], _WANT).copy()
                for x in r.pop("reached") or ():
                    wants["best"][x["want"]] = x["score"]
                live = np.maximum(wants["low"], wants["best"])
                r["wants"], r["need"] = wants.tobytes(), float(live.min()) if len(live) else np.inf
                out.append([r[c] for c in _BLOCK_NAMES])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BLOCK_KINDS)], names=_BLOCK_NAMES)

    joined = anchors.join(thresholds, anchors["block"] == thresholds["ablock"], "left")
    return joined.select(*_BLOCK_NAMES, "reached").mapInArrow(put, BLOCK_SCHEMA)


def dual_tree(anchor_rows: DataFrame, candidates: DataFrame, planes: Planes, same: bool, k: int) -> DataFrame:
    """(anchor_id, key, score, found_id, nth): for each want of the anchors its k best finds."""
    anchors = cut_blocks(ordered(anchor_rows, planes), ANCHOR_BLOCK, ANCHOR_LEAF)
    nearer = Window.partitionBy("ablock").orderBy(F.desc("upper"), "cblock").rowsBetween(Window.unboundedPreceding, -1)
    opened = meeting_blocks(anchors, candidates, same).withColumn("before", F.coalesce(F.sum("rows").over(nearer), F.lit(0)))
    opened = checkpoint(opened.filter(F.col("before") < SEEDS).select("ablock", "cblock"))
    seeds = checkpoint(_best(_search(opened, anchors, candidates, same, k), k))
    anchors = checkpoint(_raised(anchors, seeds, k))
    rest = meeting_blocks(anchors, candidates, same).join(opened, ["ablock", "cblock"], "left_anti")
    found = seeds.drop("nth").unionByName(_search(rest, anchors, candidates, same, k))
    return _best(found, k).select("anchor_id", "key", "score", "found_id", "nth")


# -- the operator ---------------------------------------------------------------------


def usable_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vector (whole numbers): the rows that take part, one for each vec_id.

    Rows without an id, a label or a vector, and those with a component that is null or not
    finite, take no part; of rows with one id that with the smallest label, then vector, does."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(finite)
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-LARGEST)), F.lit(LARGEST)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), whole.alias("vector"))
    twice = checkpoint(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if twice.isEmpty():
        return rows
    first = rows.join(twice, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    return rows.join(twice, "vec_id", "left_anti").unionByName(first)


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, relabel: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of the same label; for each,
    the ``negatives`` best rows of other labels follow whose score is between ``low`` and
    ``high`` percent of the positive's.  Scores are inner products of whole numbers; ties go
    by smaller id.  ``relabel`` is an SQL expression for the label, of ``vec_id`` and ``label``.

    See ``usable_rows`` for nulls and repeated ids.  A shorter vector counts as filled with
    zeros, an empty one as zeros alone; components are held to +-2**52 and scores to the range
    of a long.  A negative positive_score has no negatives, and one of zero those of zero.
    Without anchors, or on an empty table, there are no rows.  Other columns are not read.
    """
    rows = usable_rows(vectors.selectExpr("vec_id", "embedding", f"cast({relabel or 'label'} as int) label"), scale)
    sample = rows.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("vector").combine_chunks()
    planes = fit_planes(_rows_of(sample).astype(np.float64) if len(sample) else np.zeros((0, 1)))
    wants = "array<struct<key:long,low:long,high:long>>"
    candidates = cut_blocks(ordered(rows.withColumn("wants", F.lit(None).cast(wants)), planes), BLOCK, LEAF)
    anchors = rows.filter(is_anchor)
    everything = F.array(F.struct(F.col("vec_id").alias("key"), F.lit(int(_LEAST)).alias("low"), F.lit(int(_MOST)).alias("high")))
    found = dual_tree(anchors.withColumn("wants", everything), candidates, planes, True, positives)
    pairs = checkpoint(found.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    part = F.col("positive_score").cast("decimal(20,0)")
    band = pairs.filter("positive_score >= 0").select(
        F.col("anchor_id").alias("vec_id"),
        F.struct(F.col("positive_id").alias("key"), F.ceil(part * low / 100).cast("long").alias("low"), F.floor(part * high / 100).cast("long").alias("high")).alias("want"),
    )
    wanted = band.groupBy("vec_id").agg(F.sort_array(F.collect_list("want")).alias("wants"))
    mined = dual_tree(anchors.join(wanted, "vec_id"), candidates, planes, False, negatives)
    mined = mined.select("anchor_id", F.col("key").alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: For tables in which a vec_id names one row and all vectors have one length.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10
"""
