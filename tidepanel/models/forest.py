"""Many random forests in the same passes: all candidates, folds and trees of a grid at once.

Rows are binned once per fold.  Every (candidate, fold, tree) draws Poisson bootstrap weights by a hash of row and tree, so a
lost task draws the same sample again, and nothing is stored per tree.

Large nodes are split from histograms: one job per level sums (rows, weight, weight of class 1) per
node, feature and bin, in groups of requests that fit ``CELLS``.  A node with at most ``LOCAL_ROWS`` rows is handed over: its rows go to
one task, which grows the rest of the subtree there.  Where a whole fold is that small, a task
takes the fold's rows once for ``TREES_PER_TASK`` trees.  Both ways see the same counts and choose the same splits.

No model passes the driver: a task also scores the rows that reach its node, and the
probabilities are summed per row.

Published background: random forests; in-memory completion of small nodes as in the PLANET paper.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models.boosting import MAX_FOLDS, _as_binary, _as_matrix, binned_rows, feature_edges, subset_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL_ROWS = 100_000  # below 2**17: the three counts of a bin share one exact double
TREES_PER_TASK = 25
CELLS = 1 << 20  # histogram cells that one job brings to the driver
UNIT_SCHEMA = "unit int, node long, ROW_ID long, y double, side int, bins binary"
PART_SCHEMA = "plan int, fold int, ROW_ID long, y double, side int, votes double, seconds double"
NODE_SCHEMA = "plan int, fold int, tree int, node long, feature int, cut int, gain double, n long, weight double, p1 double"
TRAIN, VALID = 1, 2


@dataclass(frozen=True)
class Forest:
    """Settings of a random forest; an untrained model."""

    trees: int = 200
    max_depth: int | None = 8
    min_rows: int = 20
    min_split: int = 2
    max_features: int | float | str | None = "sqrt"
    bootstrap: bool = True
    class_weight: object = None
    bins: int = 128
    seed: int = 42

    def with_settings(self, **changes) -> Forest:
        return replace(self, **changes)


@dataclass
class _Tree:
    """Nodes of a tree by heap number (children of i: 2i, 2i+1), ascending; feature -1 marks a leaf."""

    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    n: list = field(default_factory=list)
    weight: list = field(default_factory=list)
    p1: list = field(default_factory=list)

    def add(self, node, feature, cut, gain, n, weight, p1) -> None:
        for column, values in zip((self.node, self.feature, self.cut, self.gain, self.n, self.weight, self.p1), (node, feature, cut, gain, n, weight, p1)):
            column.append(np.asarray(values))

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) if c else np.empty(0) for c in (self.node, self.feature, self.cut, self.gain, self.n, self.weight, self.p1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(*parts: int) -> np.uint64:
    total = 0
    for p in parts:
        total = (total * 0x9E3779B97F4A7C15 + p + 1) % 2**64
    return np.uint64(total)


# Chances of a Poisson variable of mean 1 to be at most 0, 1, 2, ...; as many as doubles can tell.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def weights_of(row_ids: np.ndarray, plan: Forest, fold: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's sample."""
    if not plan.bootstrap:
        return np.ones(len(row_ids), np.int64)
    with np.errstate(over="ignore"):
        x = _mixed(_mixed(row_ids.astype(np.uint64)) + _salt(plan.seed, fold, tree))
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) * 2.0**-53, side="right")


def tried_features(plan: Forest, fold: int, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """(nodes x tried) feature numbers, ascending: those with the smallest hashes."""
    size = subset_size(plan.max_features, width)
    if size == width:
        return np.broadcast_to(np.arange(width), (len(nodes), width))
    with np.errstate(over="ignore"):
        x = _mixed(nodes.astype(np.uint64) + _salt(plan.seed, fold, tree, 7))[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(np.argpartition(_mixed(x), size - 1, axis=1)[:, :size], axis=1)


def _purity(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    total = ones + zeros
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, (ones * ones + zeros * zeros) / total, 0.0)


def best_cuts(n, w, p, plan: Forest, class_weights):
    """(gain, cut) per node for one feature from counts (nodes x bins) of rows, weight and weight of class 1."""
    n, w, p = (np.cumsum(c, axis=1) for c in (n, w, p))
    ones, zeros = p * class_weights[1], (w - p) * class_weights[0]
    all_ones, all_zeros = ones[:, -1:], zeros[:, -1:]
    total = all_ones + all_zeros
    gain = (_purity(ones, zeros) + _purity(all_ones - ones, all_zeros - zeros) - _purity(all_ones, all_zeros)) / np.where(total > 0, total, 1.0)
    least = max(1, plan.min_rows)
    gain = np.where((n >= least) & (n[:, -1:] - n >= least), gain, -np.inf)
    cut = np.argmax(gain, axis=1)
    return gain[np.arange(len(gain)), cut], cut


def _open(plan: Forest, n, w, p, depth: int) -> np.ndarray:
    """Which nodes may be split at all."""
    deep = plan.max_depth is not None and depth >= plan.max_depth
    return (n >= max(plan.min_split, 2 * plan.min_rows, 2)) & (p > 0) & (p < w) & (not deep)


def _share(w, p, class_weights):
    ones, zeros = p * class_weights[1], (w - p) * class_weights[0]
    return np.where(ones + zeros > 0, ones / np.where(ones + zeros > 0, ones + zeros, 1.0), 0.0)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, plan: Forest, fold: int, tree: int, class_weights, root: int = 1) -> _Tree:
    """The subtree below heap node ``root`` from all rows that reach it; level by level, all nodes of a level together."""
    grown = _Tree()
    inside = np.flatnonzero(weight)
    bins, w = bins[inside], weight[inside].astype(float)
    packed = 1.0 + w * 2.0**17 + w * (y[inside] > 0) * 2.0**35
    width, size = bins.shape[1], plan.bins
    nodes, at, depth = np.array([root], np.int64), np.zeros(len(inside), np.int64), int(root).bit_length() - 1
    columns = np.ascontiguousarray(bins.T)
    while len(nodes):
        n, w, p = _unpacked(np.bincount(at, packed, minlength=len(nodes)))
        share = _share(w, p, class_weights)
        may = _open(plan, n, w, p, depth)
        feature, cut, gain = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
        if may.any():
            place = np.cumsum(may) - 1
            rows = np.flatnonzero(may[at])
            seat, mass = place[at[rows]], packed[rows]
            k = int(may.sum())
            tried = tried_features(plan, fold, tree, nodes[may], width)
            best, which, where = np.full(k, 1e-12), np.full(k, -1), np.zeros(k, np.int64)
            for j in range(tried.shape[1]):
                own = tried[:, j]
                values = columns[own[0]][rows] if (own == own[0]).all() else columns[own[seat], rows]
                counts = _unpacked(np.bincount(seat * size + values, mass, minlength=k * size).reshape(k, size))
                g, c = best_cuts(*counts, plan, class_weights)
                better = g > best
                best, which, where = np.where(better, g, best), np.where(better, own, which), np.where(better, c, where)
            feature[may], cut[may], gain[may] = which, where, np.where(which >= 0, best, 0.0)
        grown.add(nodes, feature, cut, gain, n, w, share)
        split = feature >= 0
        keep = np.flatnonzero(split[at])
        at = at[keep]
        packed, columns = packed[keep], columns[:, keep]
        right = columns[feature[at], np.arange(len(keep))] > cut[at]
        order = np.cumsum(split) - 1
        at = 2 * order[at] + right
        nodes = np.stack([2 * nodes[split], 2 * nodes[split] + 1], axis=1).ravel()
        depth += 1
    return grown


def _unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = sums.astype(np.int64)
    return whole & (2**17 - 1), (whole >> 17) & (2**18 - 1), whole >> 35


def walk(columns: list[np.ndarray], bins: np.ndarray, root: int = 1) -> np.ndarray:
    """Index of the leaf (or last known node) that each row reaches."""
    node, feature, cut = columns[0].astype(np.int64), columns[1].astype(np.int64), columns[2]
    order = np.argsort(node)
    known = node[order]
    at = np.full(len(bins), order[np.searchsorted(known, root)])
    left = np.searchsorted(known, 2 * node)
    left_at = np.where(feature >= 0, order[np.minimum(left, len(order) - 1)], -1)
    right_at = np.where(feature >= 0, order[np.minimum(left + 1, len(order) - 1)], -1)
    rows = np.arange(len(bins))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        rows_in = rows[inner]
        here = at[inner]
        below = bins[rows_in, feature[here]] <= cut[here]
        at[inner] = np.where(below, left_at[here], right_at[here])


# ---- passes over the rows ----------------------------------------------------

@dataclass
class _Job:
    """One tree of one candidate on one fold while its top is grown."""

    plan: int
    fold: int
    tree: int
    top: _Tree = field(default_factory=_Tree)
    open: list = field(default_factory=list)  # heap numbers that wait for a histogram
    handed: list = field(default_factory=list)  # heap numbers that a task finishes


class _Rows:
    """Arrays of one batch of binned rows (see ``boosting.binned_rows``)."""

    def __init__(self, batch: pa.RecordBatch, width: int, folds: int):
        self.ids, self.y, self.train, self.valid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        self.bins = _as_matrix(batch.column(4), np.uint8, width * folds).reshape(-1, folds, width)

    def side(self, fold: int) -> np.ndarray:
        return ((self.train >> fold) & 1) * TRAIN + ((self.valid >> fold) & 1) * VALID


def _grow_tops(rows: DataFrame, jobs: list[_Job], plans: Sequence[Forest], weights, width: int, folds: int) -> None:
    """Split the nodes of more than LOCAL_ROWS rows, one level of all trees per round."""
    for job in jobs:
        job.open = [1]
    while any(job.open for job in jobs):
        requests = [(job, node) for job in jobs for node in sorted(job.open)]
        for job in jobs:
            job.open = []
        share: list = []
        cells = 0
        for job, node in requests:
            need = subset_size(plans[job.plan].max_features, width) * plans[job.plan].bins
            if share and cells + need > CELLS:
                _split_tops(rows, share, plans, weights, width, folds)
                share, cells = [], 0
            share.append((job, node))
            cells += need
        if share:
            _split_tops(rows, share, plans, weights, width, folds)


def _top_columns(job: _Job) -> list[np.ndarray]:
    """The known top; nodes that wait or are handed over stand as leaves."""
    columns = job.top.columns()
    waiting = np.array(sorted({1} if not len(columns[0]) else {c for i, f in zip(columns[0], columns[1]) if f >= 0 for c in (2 * i, 2 * i + 1)} - set(columns[0])), np.int64)
    filled = [np.concatenate([columns[0], waiting]), np.concatenate([columns[1], np.full(len(waiting), -1)])]
    return filled + [np.concatenate([c, np.zeros(len(waiting))]) for c in columns[2:]]


def _split_tops(rows: DataFrame, share: list, plans: Sequence[Forest], weights, width: int, folds: int) -> None:
    by_job: dict[int, list] = {}
    jobs: dict[int, _Job] = {}
    tried = []
    for number, (job, node) in enumerate(share):
        by_job.setdefault(id(job), []).append((number, node))
        jobs[id(job)] = job
        tried.append(tried_features(plans[job.plan], job.fold, job.tree, np.array([node]), width)[0])
    known = [(jobs[k].plan, jobs[k].fold, jobs[k].tree, _top_columns(jobs[k]), wanted) for k, wanted in by_job.items()]

    def task(batches):
        sums = [np.zeros((3, len(t), plans[job.plan].bins), np.int64) for t, (job, _) in zip(tried, share)]
        for batch in batches:
            b = _Rows(batch, width, folds)
            for number_of_plan, fold, tree, top, wanted in known:
                plan = plans[number_of_plan]
                at = np.flatnonzero((b.train >> fold) & 1 == 1)
                w = weights_of(b.ids[at], plan, fold, tree)
                at, w = at[w > 0], w[w > 0]
                codes = b.bins[at, fold]
                node_of = top[0][walk(top, codes)]
                for number, node in wanted:
                    here = np.flatnonzero(node_of == node)
                    size = len(tried[number])
                    place = (codes[here][:, tried[number]].astype(np.int64) + np.arange(size) * plan.bins).ravel()
                    mass = w[here]
                    for s, weight in enumerate((None, mass, mass * (b.y[at[here]] > 0))):
                        repeated = None if weight is None else np.repeat(weight, size)
                        sums[number][s] += np.bincount(place, repeated, minlength=size * plan.bins).reshape(size, plan.bins).astype(np.int64)
        for number, counts in enumerate(sums):
            feature, bin_ = np.nonzero(counts[0])
            if len(feature):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(feature), number, np.int32)), pa.array(feature.astype(np.int32)), pa.array(bin_.astype(np.int32)), *[pa.array(c[feature, bin_]) for c in counts]],
                    names=["request", "feature", "bin", "n", "w", "p"],
                )

    summed = rows.mapInArrow(task, "request int, feature int, bin int, n long, w long, p long").groupBy("request", "feature", "bin")
    summed = summed.agg(*[F.sum(c).alias(c) for c in "nwp"]).toArrow()
    request, feature, bin_, *counts = (column.to_numpy() for column in summed.columns)
    for number, (job, node) in enumerate(share):
        plan = plans[job.plan]
        table = np.zeros((3, len(tried[number]), plan.bins), np.int64)
        mine = np.flatnonzero(request == number)
        table[:, feature[mine], bin_[mine]] = [c[mine] for c in counts]
        _decide_top(job, node, table, tried[number], plan, weights[job.plan, job.fold])


def _decide_top(job: _Job, node: int, table: np.ndarray, tried: np.ndarray, plan: Forest, class_weights) -> None:
    n, w, p = table[:, 0].sum(axis=1)
    if n <= LOCAL_ROWS:  # only a root can turn out so small
        job.handed.append(node)
        return
    depth = int(node).bit_length() - 1
    which, where, best = -1, 0, 0.0
    if _open(plan, n, w, p, depth):
        gains, cuts = best_cuts(*table, plan, class_weights)
        j = int(np.argmax(gains))
        if gains[j] > 1e-12:
            which, where, best = int(tried[j]), int(cuts[j]), float(gains[j])
    job.top.add([node], [which], [where], [best], [n], [w], [float(_share(w, p, class_weights))])
    if which >= 0:
        j = int(np.flatnonzero(tried == which)[0])
        low = int(table[0, j, : where + 1].sum())
        for child, rows in ((2 * node, low), (2 * node + 1, int(n) - low)):
            (job.handed if rows <= LOCAL_ROWS else job.open).append(child)


def _finish(units: list, plans: Sequence[Forest], weights, width: int, scored: bool):
    """Grow and score (or return) the subtrees of one unit's node from all rows that reach it."""

    def finish(key, table):
        plan_number, fold, first, last = units[key[0].as_py()]
        plan, root = plans[plan_number], key[1].as_py()
        table = table.combine_chunks()
        ids, y, side = (table.column(i).to_numpy() for i in (2, 3, 4))
        chunk = table.column(5).combine_chunks()
        bins = _as_matrix(chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk, np.uint8, width)
        order = np.argsort(ids, kind="stable")
        ids, y, side, bins = ids[order], y[order], side[order], bins[order]
        train = np.flatnonzero(side & TRAIN)
        votes, found, begun = np.zeros(len(ids)), [], time.perf_counter()
        for tree in range(first, last):
            w = weights_of(ids[train], plan, fold, tree)
            columns = grow(bins[train], y[train], w, plan, fold, tree, weights[plan_number, fold], root).columns()
            if scored:
                votes += columns[6][walk(columns, bins, root)]
            else:
                found.append((tree, columns))
        if not scored:
            return pa.concat_tables([_node_table(plan_number, fold, tree, columns) for tree, columns in found])
        spent = (time.perf_counter() - begun) / max(1, len(ids))
        return pa.table([
            pa.array(np.full(len(ids), plan_number, np.int32)), pa.array(np.full(len(ids), fold + 1, np.int32)), pa.array(ids), pa.array(y), pa.array(side.astype(np.int32)),
            pa.array(votes), pa.array(np.full(len(ids), spent)),
        ], names=["plan", "fold", "ROW_ID", "y", "side", "votes", "seconds"])

    return finish


def _node_table(plan: int, fold: int, tree: int, columns: list[np.ndarray]) -> pa.Table:
    n = len(columns[0])
    kinds = (np.int64, np.int32, np.int32, float, np.int64, float, float)
    head = [pa.array(np.full(n, v, np.int32)) for v in (plan, fold + 1, tree)]
    return pa.table([*head, *[pa.array(c.astype(k)) for c, k in zip(columns, kinds)]], names=["plan", "fold", "tree", "node", "feature", "cut", "gain", "n", "weight", "p1"])


def _prepared(df: DataFrame, features: Sequence[str], label: str, folds: int, plans: Sequence[Forest]):
    """(binned rows, class weights per plan and fold, jobs with grown tops, folds that a task can hold)."""
    if not 1 <= folds <= MAX_FOLDS:
        raise ValueError(f"between 1 and {MAX_FOLDS} folds can be trained together")
    S.require_columns(df, [S.ROW_ID, label, "train", "valid", *features], "forest")
    if len({plan.bins for plan in plans}) != 1:
        raise ValueError("forests that are trained together need the same number of bins")
    edges = feature_edges(df, features, plans[0].bins, folds)
    if not edges:
        raise ValueError("no training rows")
    rows = binned_rows(df, features, label, edges).persist(StorageLevel.MEMORY_AND_DISK)
    inside = [F.col("train").bitwiseAND(1 << f) != 0 for f in range(folds)]
    sizes = rows.agg(*[F.count_if(c) for c in inside], *[F.count_if(c & (F.col("y") > 0)) for c in inside]).first()
    counts = [(sizes[f] - sizes[folds + f], sizes[folds + f]) for f in range(folds)]
    weights = {(i, f): _class_weights(plan.class_weight, counts[f]) for i, plan in enumerate(plans) for f in range(folds)}
    small = [f for f in range(folds) if sizes[f] <= LOCAL_ROWS]
    jobs = [_Job(i, f, t) for i, plan in enumerate(plans) for f in range(folds) if f not in small for t in range(plan.trees)]
    _grow_tops(rows, jobs, plans, weights, len(features), folds)
    return rows, weights, jobs, small


def _class_weights(rule, counts) -> tuple[float, float]:
    if rule is None:
        return 1.0, 1.0
    if rule == "balanced":
        return tuple(sum(counts) / (2.0 * c) if c else 1.0 for c in counts)
    return float(rule.get(0, 1.0)), float(rule.get(1, 1.0))


def _units(rows: DataFrame, jobs: list[_Job], small: list[int], plans: Sequence[Forest], width: int, folds: int):
    """(units, rows dealt to the tasks that finish them): unit = (plan, fold, first tree, last tree)."""
    whole = [(i, f, a, min(a + TREES_PER_TASK, plan.trees)) for i, plan in enumerate(plans) for f in small for a in range(0, plan.trees, TREES_PER_TASK)]
    parts = [(job, _top_columns(job), np.array(sorted(job.handed), np.int64)) for job in jobs if job.handed]
    units = whole + [(job.plan, job.fold, job.tree, job.tree + 1) for job, *_ in parts]

    def deal(batches):
        for batch in batches:
            b = _Rows(batch, width, folds)
            sides = {f: b.side(f) for f in range(folds)}
            for unit, (_, fold, _, _) in enumerate(whole):
                at = np.flatnonzero(sides[fold])
                if len(at):
                    yield _dealt(unit, np.ones(len(at), np.int64), at, fold, b, sides[fold])
            for unit, (job, top, handed) in enumerate(parts, start=len(whole)):
                at = np.flatnonzero(sides[job.fold])
                node = top[0][walk(top, b.bins[at, job.fold])]
                mine = np.isin(node, handed)
                if mine.any():
                    yield _dealt(unit, node[mine], at[mine], job.fold, b, sides[job.fold])

    dealt = rows.mapInArrow(deal, UNIT_SCHEMA)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * len(whole))
    return units, dealt.repartition(n, "unit", "node").groupBy("unit", "node")


def _dealt(unit: int, node: np.ndarray, at: np.ndarray, fold: int, b: _Rows, side: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), unit, np.int32)), pa.array(node), pa.array(b.ids[at]), pa.array(b.y[at]), pa.array(side[at].astype(np.int32)), _as_binary(b.bins[at, fold])],
        names=["unit", "node", "ROW_ID", "y", "side", "bins"],
    )


def score_forests(df: DataFrame, features: Sequence[str], label: str, folds: int, plans: Sequence[Forest]) -> DataFrame:
    """plan, fold (from 1), ROW_ID, y, side (1 train, 2 valid, 3 both), p1, prediction, seconds: every row that a fold trains or validates.

    Bit f of ``train`` and ``valid`` says on which side of fold f a row is.
    """
    features, plans = list(features), list(plans)
    width = len(features)
    rows, weights, jobs, small = _prepared(df, features, label, folds, plans)
    units, dealt = _units(rows, jobs, small, plans, width, folds)
    votes = dealt.applyInArrow(_finish(units, plans, weights, width, True), PART_SCHEMA)
    tops = [(job.plan, job.fold, _top_columns(job), np.array(sorted(job.handed), np.int64)) for job in jobs]
    if tops:
        votes = votes.unionByName(rows.mapInArrow(_top_votes(tops, width, folds), PART_SCHEMA))
    trees = F.element_at(F.lit([float(p.trees) for p in plans]), F.col("plan") + 1)
    share = F.round(F.sum("votes") / trees, 12)  # the order of the sums does not show
    summed = votes.groupBy("plan", "fold", "ROW_ID", "y", "side").agg(share.alias(S.PROBABILITY), F.sum("seconds").alias("seconds"))
    return summed.withColumn(S.PREDICTION, F.when(F.col(S.PROBABILITY) > 0.5, 1).otherwise(0))


def _top_votes(tops, width: int, folds: int):
    """Probabilities of rows that end in a leaf of a tree's top."""

    def task(batches):
        for batch in batches:
            b = _Rows(batch, width, folds)
            for plan, fold, top, handed in tops:
                side = b.side(fold)
                at = np.flatnonzero(side)
                leaf = walk(top, b.bins[at, fold])
                mine = ~np.isin(top[0][leaf], handed)
                at, leaf = at[mine], leaf[mine]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), plan, np.int32)), pa.array(np.full(len(at), fold + 1, np.int32)), pa.array(b.ids[at]), pa.array(b.y[at]),
                            pa.array(side[at].astype(np.int32)), pa.array(top[6][leaf].astype(float)), pa.array(np.zeros(len(at))),
                        ],
                        names=["plan", "fold", "ROW_ID", "y", "side", "votes", "seconds"],
                    )

    return task


def forest_nodes(df: DataFrame, features: Sequence[str], label: str, folds: int, plans: Sequence[Forest]) -> DataFrame:
    """The trees as a table: plan, fold, tree, node (heap number), feature (-1: leaf), cut (bin), gain, n, weight, p1."""
    features, plans = list(features), list(plans)
    rows, weights, jobs, small = _prepared(df, features, label, folds, plans)
    units, dealt = _units(rows, jobs, small, plans, len(features), folds)
    nodes = dealt.applyInArrow(_finish(units, plans, weights, len(features), False), NODE_SCHEMA)
    tops = [_node_table(job.plan, job.fold, job.tree, job.top.columns()) for job in jobs if job.top.node]
    if tops:
        nodes = nodes.unionByName(df.sparkSession.createDataFrame(pa.concat_tables(tops)).select(*nodes.columns))
    return nodes
