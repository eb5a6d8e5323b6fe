"""Distributed boosting on histograms, for several temporal folds at once.

Rows are binned once (one byte per feature) and kept, in blocks of up to ``BLOCK``
rows, column by column, in as many partitions as their size asks for.  A boosting step is one
Spark job: every task sums gradients per (fold, node, feature, bin) over its own
rows, Spark adds the partial sums up, and the driver picks splits from that
table, whose size depends on folds, nodes, features and bins but not on rows.
Rows stay on the executors.

The folds share the pass: a row carries a bit per fold it trains, and a task sends
all its sums as one packed row, which few reducers add up.  Rows keep the margins
of the ensemble; every ``REFRESH`` rounds the kept rows take in the new trees, and
tasks add the few trees since.  Every ``CHECKPOINT`` rounds the rows are written to the
checkpoint folder, so a lost executor costs its own partitions and few rounds.

Published background: AdaBoost (SAMME), gradient boosting machines, and the
XGBoost, LightGBM and CatBoost papers.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.functions.sizing import pass_tasks
from tidepanel.models import trees_numpy
from tidepanel.models.trees_numpy import (
    Tree, bin_values, gradients, leaf_of, margin_of, sampled, sigmoid,
)
from tidepanel.session import ensure_checkpoint_dir

# The helpers travel with the tasks: executors need no installed copy of this package.
for _module in (trees_numpy, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

REFRESH = 10
CHECKPOINT = 50
BLOCK = 8192  # rows in one block of the kept table
SEGMENT = 1 << 19  # sums in one packed row
SHORT_SEGMENT = 1 << 16  # sums in one array of a boosting pass
FAN_IN = 64  # arrays that one reducer adds up
DIRECT_BYTES = 1 << 25  # packed rows of all tasks that the driver adds up itself
BINNED_SCHEMA = "ROW_ID long, y double, train int, valid int, bins binary, base binary"
BLOCK_SCHEMA = "ids binary, y binary, train binary, valid binary, bins binary, base binary"
SUMS_SCHEMA = "segment int, lane int, sums binary"
SCORED_SCHEMA = "ROW_ID long, fold int, y double, margin double, p1 double, prediction int"
MAX_FOLDS = 30


@dataclass(frozen=True)
class Boosting:
    """Settings of a boosted ensemble; an untrained model."""

    rounds: int
    rate: float
    max_depth: int = 2
    loss: str = "logistic"  # logistic | squared | exponential
    criterion: str = "newton"  # newton | variance | gini
    growth: str = "level"  # level | leaf | symmetric
    max_leaves: int | None = None
    min_rows: int = 1
    min_hessian: float = 0.0
    gamma: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    row_every: int = 1
    tree_features: float = 1.0
    node_features: int | float | str | None = None
    prior: bool = True
    bins: int = 64
    seed: int = 42

    def with_settings(self, **changes) -> Boosting:
        return replace(self, **changes)


def subset_size(rule: int | float | str | None, n: int) -> int:
    """Number of features tried, from None, "sqrt", "log2", a count or a share."""
    if rule is None:
        return n
    if rule == "sqrt":
        return max(1, int(math.sqrt(n)))
    if rule == "log2":
        return max(1, int(math.log2(n)))
    if isinstance(rule, float):
        return max(1, int(rule * n))
    if isinstance(rule, int):
        return max(1, min(rule, n))
    raise ValueError(f"unknown feature subset rule {rule!r}")


# ---- rows ------------------------------------------------------------------

def feature_edges(df: DataFrame, features: Sequence[str], bins: int, folds: int) -> list[list[np.ndarray]]:
    """Per fold at most ``bins``-1 ascending cut points per feature, from mergeable sketches in one pass.

    A fold's sketches see its own training rows only (bit f of ``train``).  Empty when a fold has none.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    shares = [i / bins for i in range(1, bins)]
    names = [f"x_{i}" for i in range(len(features))]
    filled = df.select("train", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)])
    # one group per feature; rows are folded into sketches before the shuffle
    own = [F.when(F.col("train").bitwiseAND(1 << f) != 0, F.col("value")) for f in range(folds)]
    rows = filled.where("train != 0").unpivot(["train"], names, "x", "value").groupBy("x").agg(
        *[F.percentile_approx(v, shares, 20 * bins).alias(f"cuts_{f}") for f, v in enumerate(own)]
    )
    found = {row["x"]: row for row in rows.collect()}
    if not found or any(row[f"cuts_{f}"] is None for row in found.values() for f in range(folds)):
        return []
    return [[np.unique(np.asarray(found[n][f"cuts_{f}"], dtype=float)) for n in names] for f in range(folds)]


def binned_rows(df: DataFrame, features: Sequence[str], label: str, edges: list[list[np.ndarray]], parts: int | None = None) -> DataFrame:
    """(ROW_ID, y, train, valid, bins): features as bytes, fold after fold; ``df`` has the fold bits train and valid."""
    width = len(features)

    def task(batches):
        for batch in batches:
            n = batch.num_rows
            values = np.column_stack([batch.column(4 + j).to_numpy(zero_copy_only=False) for j in range(width)])
            codes = np.concatenate([bin_values(values.reshape(n, width), own) for own in edges], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), _as_binary(codes), pa.array([b""] * n, pa.binary())],
                names=["ROW_ID", "y", "train", "valid", "bins", "base"],
            )

    rows = df.where((F.col("train") != 0) | (F.col("valid") != 0)).select(
        F.col(S.ROW_ID).cast("long"),
        F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"),
        F.col("train").cast("int"),
        F.col("valid").cast("int"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(features)],
    )
    # one shuffle of short rows, so that all tasks of the many passes get equal shares
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(task, BINNED_SCHEMA).repartition(parts, S.ROW_ID)


def blocks_of(rows: DataFrame, width: int, folds: int) -> DataFrame:
    """Binned rows of a partition, ``BLOCK`` at a time, as one row of arrays; ``base`` is empty until margins are stored."""
    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                bins = np.ascontiguousarray(_as_matrix(part.column(4), np.uint8, folds * width).T)
                yield _block_row([*columns, bins, b""])

    return rows.mapInArrow(task, BLOCK_SCHEMA)


def _block_row(arrays: list) -> pa.RecordBatch:
    names = ["ids", "y", "train", "valid", "bins", "base"]
    return pa.RecordBatch.from_arrays([pa.array([memoryview(a).tobytes()], pa.binary()) for a in arrays], names=names)


def _as_binary(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous matrix, without a copy per row."""
    matrix = np.ascontiguousarray(matrix)
    step = matrix.strides[0] if len(matrix) else 0
    offsets = pa.py_buffer((np.arange(len(matrix) + 1, dtype=np.int64) * step).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(matrix)])


def _as_matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of :func:`_as_binary`."""
    n = len(column)
    if not n:
        return np.empty((0, width), dtype=dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=column.offset * 4)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(n, width) if data.size else np.empty((n, 0), dtype=dtype)


class _Block:
    """Array view of a block of binned rows; ``bins[f]`` has the rows of fold f as columns."""

    def __init__(self, arrays, width: int, folds: int):
        kinds = (np.int64, np.float64, np.int32, np.int32, np.uint8, np.float64)
        self.ids, self.y, self.train, self.valid, bins, base = (np.frombuffer(a, k) if len(a) else np.empty(0, k) for a, k in zip(arrays, kinds))
        self.bins = bins.reshape(folds, width, len(self.y))
        self.base = base.reshape(folds, len(self.y)) if len(base) else None

    def base_of(self, fold: int) -> np.ndarray | float:
        return 0.0 if self.base is None else self.base[fold]


def _blocks(batch: pa.RecordBatch, width: int, folds: int):
    for i in range(batch.num_rows):
        yield _Block([memoryview(column[i].as_buffer()) for column in batch.columns], width, folds)


# ---- training --------------------------------------------------------------

@dataclass
class _Member:
    """Training state of one fold."""

    index: int
    prior: float
    trees: list[Tree] = field(default_factory=list)
    merged: int = 0  # trees already contained in the stored margins
    tree: Tree = field(default_factory=Tree)
    open: list[int] = field(default_factory=list)
    stats: dict = field(default_factory=dict)  # node -> (G, H, N)
    tables: dict = field(default_factory=dict)  # node -> histogram
    tried: dict = field(default_factory=dict)  # node -> feature numbers
    siblings: dict = field(default_factory=dict)  # node -> (parent, sibling)
    done: bool = False


@dataclass
class BoostedModel:
    """Trained ensemble of one fold."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    prior: float
    loss: str

    def importances(self) -> dict[str, float]:
        """Total gain per feature."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for node, child in enumerate(tree.left):
                if child >= 0:
                    total[self.features[tree.feature[node]]] += tree.gain[node]
        return total

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, cut, left, right, value, gain) of all nodes; leaves have neither feature, cut nor gain."""
        found = []
        for number, tree in enumerate(self.trees, start=1):
            for node, left in enumerate(tree.left):
                feature = tree.feature[node]
                if left >= 0:
                    found.append((number, node, self.features[feature], float(self.edges[feature][tree.cut[node]]), left, tree.right[node], None, tree.gain[node]))
                else:
                    found.append((number, node, None, None, None, None, float(tree.value[node]), None))
        return found

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return _probability(self.loss, margin, _vote_weight(self.trees))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``margin``, ``p1`` and ``prediction``; only the feature columns go through Arrow."""
        S.require_columns(df, self.features, "scoring")
        edges, trees, prior, loss = self.edges, self.trees, self.prior, self.loss
        votes = _vote_weight(trees)

        @F.pandas_udf("margin double, p1 double")
        def score(*columns: pd.Series) -> pd.DataFrame:
            values = np.column_stack([c.fillna(0.0).to_numpy(dtype=float) for c in columns])
            margin = prior + margin_of(trees, bin_values(values, edges))
            return pd.DataFrame({"margin": margin, "p1": _probability(loss, margin, votes)})

        scored = df.withColumn("__s", score(*[F.col(c).cast("double") for c in self.features]))
        scored = scored.select(*df.columns, F.col("__s.margin").alias("margin"), F.col("__s.p1").alias(S.PROBABILITY))
        cut = F.col("margin") > 0 if loss == "squared" else F.col(S.PROBABILITY) > 0.5
        return scored.withColumn(S.PREDICTION, F.when(cut, 1).otherwise(0))


def _vote_weight(trees: list[Tree]) -> float:
    return sum(max(abs(v) for v in tree.value) for tree in trees)


def _probability(loss: str, margin: np.ndarray, votes: float) -> np.ndarray:
    if loss == "exponential":  # weighted vote in [-1, 1], then the logistic link
        return sigmoid(2.0 * margin / votes) if votes else np.full(len(margin), 0.5)
    return sigmoid(margin)


def fit_folds(df: DataFrame, features: Sequence[str], label: str, folds: int, plan: Boosting, edges: list[list[np.ndarray]] | None = None):
    """(models, binned rows) of ``folds`` ensembles trained in the same passes.

    Bit f of column ``train`` puts a row into the training set of fold f.  Every
    fold has cut points of its own, from its own training rows, unless ``edges`` gives them (per fold and feature, ascending).
    """
    if not 1 <= folds <= MAX_FOLDS:
        raise ValueError(f"between 1 and {MAX_FOLDS} folds can be trained together")
    S.require_columns(df, [S.ROW_ID, label, "train", "valid", *features], "boosting")
    features = list(features)
    edges = edges or feature_edges(df, features, plan.bins, folds)
    if not edges:
        raise ValueError("no training rows")
    if any(len(cuts) >= plan.bins for own in edges for cuts in own):
        raise ValueError(f"more cut points than {plan.bins} bins allow")
    means, total = _means(df, label, folds)
    # per row: ids, labels, fold bits, bins and margins
    tasks = pass_tasks(df.sparkSession, total, 24 + folds * (len(features) + 8))
    rows = blocks_of(binned_rows(df, features, label, edges, tasks), len(features), folds).persist(StorageLevel.MEMORY_AND_DISK)
    members = [_Member(f, p) for f, p in enumerate(_priors(means, plan))]
    rng = np.random.default_rng(plan.seed)
    before, blocks = None, rows.rdd
    for turn in range(plan.rounds):
        active = [m for m in members if not m.done]
        if not active:
            break
        if turn and turn % REFRESH == 0:
            fresh = _store_margins(rows, members, len(features), turn % CHECKPOINT == 0)
            if before is not None:
                before.unpersist()
            before, rows, blocks = rows, fresh, fresh.rdd
        chosen = np.sort(rng.choice(len(features), subset_size(plan.tree_features, len(features)), replace=False))
        _grow(blocks, tasks, active, chosen, turn, plan, rng, len(features), folds)
        for m in active:
            _close_tree(m, plan)
    models = [BoostedModel(features, edges[m.index], m.trees, m.prior, plan.loss) for m in members]
    return models, rows


def _means(df: DataFrame, label: str, folds: int) -> tuple[list[float], int]:
    """(mean label of every fold's training rows, number of rows on any side)."""
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    used = df.where((F.col("train") != 0) | (F.col("valid") != 0))
    *means, total = used.agg(*[F.avg(F.when(F.col("train").bitwiseAND(1 << f) != 0, y)) for f in range(folds)], F.count("*")).first()
    if any(m is None for m in means):
        raise ValueError("a fold has no training rows")
    return means, total


def _priors(means: list[float], plan: Boosting) -> list[float]:
    """Starting margin per fold: mean, or log-odds of class 1."""
    if not plan.prior or plan.loss == "exponential":
        return [0.0] * len(means)
    if plan.loss == "squared":
        return means
    return [math.log(min(max(m, 1e-12), 1 - 1e-12) / (1 - min(max(m, 1e-12), 1 - 1e-12))) for m in means]


def _store_margins(rows: DataFrame, members: list[_Member], width: int, reliable: bool) -> DataFrame:
    """Rows with the margins reached so far, kept in memory or (``reliable``) written to the checkpoint folder; cuts the work per pass."""
    folds = len(members)
    fresh = [m.trees[m.merged :] for m in members]

    def task(batches):
        for batch in batches:
            for b in _blocks(batch, width, folds):
                new = np.stack([b.base_of(f) + margin_of(fresh[f], b.bins[f].T) for f in range(folds)])
                yield _block_row([b.ids, b.y, b.train, b.valid, b.bins, new])

    stored = rows.mapInArrow(task, BLOCK_SCHEMA)
    if reliable:
        ensure_checkpoint_dir(rows.sparkSession)
        stored = stored.checkpoint(eager=True)
    for m in members:
        m.merged = len(m.trees)
    return stored.persist(StorageLevel.MEMORY_AND_DISK)


def _merged_sums(batches):
    """Packed rows of one (segment, lane), which come one after the other, added up."""
    key, total = None, None
    for batch in batches:
        for segment, lane, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            values = np.frombuffer(packed.as_buffer(), np.float64)
            if (segment, lane) == key:
                total += values
                continue
            if key is not None:
                yield _sums_row(*key, total)
            key, total = (segment, lane), values.copy()
    if key is not None:
        yield _sums_row(*key, total)


def _sums_row(segment: int, lane: int, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([segment], pa.int32()), pa.array([lane], pa.int32()), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "lane", "sums"])


def _summed(rows: DataFrame, task, length: int) -> np.ndarray:
    """The sum over all tasks of a vector of ``length`` doubles that ``task`` yields in segments.

    Short vectors of few tasks are added by the driver; else by reducers in two rounds, so that none adds more than the root of the number of tasks.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.mapInArrow(task, SUMS_SCHEMA)
    if tasks * length * 8 > DIRECT_BYTES:
        lanes = math.isqrt(tasks)
        for lane in (F.pmod(F.spark_partition_id(), F.lit(lanes)), F.lit(0)):
            parts = parts.withColumn("lane", lane).repartition(min(tasks, lanes * (length // SEGMENT + 1)), "segment", "lane")
            parts = parts.sortWithinPartitions("segment", "lane").mapInArrow(_merged_sums, SUMS_SCHEMA)
    total = np.zeros(length)
    for batch in parts.toArrow().to_batches():
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
            values = np.frombuffer(packed.as_buffer(), np.float64)
            total[segment * SEGMENT : segment * SEGMENT + len(values)] += values
    return total


def _total(blocks: RDD, task, length: int, tasks: int) -> np.ndarray:
    """The sum over ``tasks`` partitions of the vector of ``length`` doubles that ``task`` makes of a partition's blocks.

    Passes are many and short, so they run as RDD jobs, which are planned in no time.  Short vectors of few tasks are added by the driver; others
    by reducers, segment by segment; with more than ``FAN_IN`` tasks in two rounds, so that none adds more than the root of the number of tasks.
    """
    lanes = math.isqrt(tasks) if tasks > FAN_IN else 1
    step = SHORT_SEGMENT if tasks * length * 8 > DIRECT_BYTES else length

    def pieces(index, rows):
        flat = task(rows)
        for segment, begin in enumerate(range(0, length, step)):
            yield (segment, index % lanes), flat[begin : begin + step]

    parts = blocks.mapPartitionsWithIndex(pieces)
    if step < length:
        segments = -(-length // step)
        parts = parts.reduceByKey(np.add, min(tasks, lanes * segments))
        if lanes > 1:
            parts = parts.map(lambda part: ((part[0][0], 0), part[1])).reduceByKey(np.add, min(tasks, segments))
    total = np.zeros(length)
    for (segment, _), values in parts.collect():
        total[segment * step : segment * step + len(values)] += values
    return total


def _histograms(blocks, tasks, members, requests, turn, plan, width, folds):
    """Sum of (g, h, n) per request, feature and bin.  A request is (member, node, features), those of a member stand together."""
    by_member: dict[int, list] = {}
    for member, node, tried in requests:
        by_member.setdefault(member.index, []).append((node, tried))
    state = {m.index: (m.prior, m.trees[m.merged :], m.tree) for m in members if m.index in by_member}
    loss, seed, share, bins = plan.loss, plan.seed, plan.row_share, plan.bins
    size = len(requests[0][2])
    channels = 2 if loss == "squared" else 3  # the second derivative of the squared loss is 1
    cells = size * bins
    n_requests = len(requests)  # the task must not take the requests along: they hold the histograms of the tree
    sample_turn = turn // plan.row_every if plan.row_every else None
    wanted_of, first = {}, 0
    for index, wanted in by_member.items():
        wanted_of[index] = first, [node for node, _ in wanted], np.array([tried for _, tried in wanted])
        first += len(wanted)

    def task(rows):
        sums = np.zeros((n_requests, channels, cells))
        for b in (_Block(row, width, folds) for row in rows):
            keep = np.ones(len(b.y), dtype=bool)
            if share < 1.0 and sample_turn is not None:
                keep = sampled(b.ids, share, seed, sample_turn)
            for index, (start, nodes, tried) in wanted_of.items():
                prior, trees, tree = state[index]
                own = b.bins[index]
                slots = np.full(len(tree.left), -1)
                slots[nodes] = np.arange(len(nodes))
                slot = slots[leaf_of(tree, own.T)]
                at = np.flatnonzero(keep & ((b.train >> index) & 1 == 1) & (slot >= 0))
                if not len(at):
                    continue
                margin = prior + b.base_of(index) + margin_of(trees, own.T)
                g, h = gradients(loss, b.y[at], margin[at])
                slot, first = slot[at], slot[at] * bins
                same = (tried == tried[0]).all()
                for j in range(size):
                    place = first + (own[tried[0, j]][at] if same else own[tried[slot, j], at])
                    for channel, weight in enumerate((g, h, None) if channels == 3 else (g, None)):
                        counted = np.bincount(place, weight, minlength=len(nodes) * bins)
                        sums[start : start + len(nodes), channel, j * bins : (j + 1) * bins] += counted.reshape(len(nodes), bins)
        return sums.ravel()

    sums = _total(blocks, task, n_requests * channels * cells, tasks).reshape(n_requests, channels, size, bins)
    return [np.stack([s[0], s[-1], s[-1]]) if channels == 2 else s for s in sums]


def _grow(blocks, tasks, members, chosen, turn, plan, rng, width, folds) -> None:
    """Grow one tree per member, a level (or a leaf) per job."""
    for m in members:
        m.tree, m.open = Tree(), [0]
        m.stats, m.tables, m.tried, m.siblings = {}, {}, {}, {}
    growing = list(members)
    while growing:
        requests = []
        for m in growing:
            for node in m.open:
                if node in m.tables:
                    continue
                tried = chosen
                if plan.node_features is not None:
                    size = subset_size(plan.node_features, len(chosen))
                    tried = np.sort(rng.choice(chosen, size, replace=False))
                m.tried[node] = tried
                # the larger sibling is its parent minus the smaller one
                parent, sibling = m.siblings.get(node, (None, None))
                derivable = plan.node_features is None and parent in m.tables and sibling in m.open
                larger = derivable and (m.stats[node][2], node) > (m.stats[sibling][2], sibling)
                if not larger:
                    requests.append((m, node, tried))
        if requests:
            tables = _histograms(blocks, tasks, growing, requests, turn, plan, width, folds)
            for (m, node, _), table in zip(requests, tables):
                m.tables[node] = table
                if node == 0:
                    m.stats[0] = tuple(table[:, 0, :].sum(axis=1))
            for m in growing:
                for node in m.open:
                    if node not in m.tables:
                        parent, sibling = m.siblings[node]
                        m.tables[node] = m.tables[parent] - m.tables[sibling]
        growing = [m for m in growing if _advance(m, plan)]


def _advance(m: _Member, plan: Boosting) -> bool:
    """Apply the splits that the known histograms allow; True while more are needed."""
    gains = {node: _gain_table(m.tables[node], m.stats[node], plan) for node in m.open}
    if plan.growth == "symmetric":
        best = _best_common(gains)
        splits = [(node, *best[1:]) for node in m.open] if best else []
        if splits:
            share = {node: max(float(gains[node][best[1], best[2]]), 0.0) for node in m.open}
            splits = [(node, feature, cut, share[node]) for node, feature, cut in splits]
    else:
        splits = []
        for node, gain in gains.items():
            place = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[place] > 1e-12:
                splits.append((node, int(place[0]), int(place[1]), float(gain[place])))
    if plan.growth == "leaf":
        room = (plan.max_leaves or 2**31) - len(m.tree.leaves())
        splits = sorted(splits, key=lambda s: (-s[3], s[0]))[: min(1, room)]
    split_nodes = set()
    for node, feature, cut, gain in splits:
        table = m.tables[node]
        low = tuple(table[:, feature, : cut + 1].sum(axis=1))
        high = tuple(a - b for a, b in zip(m.stats[node], low))
        left, right = m.tree.split(node, int(m.tried[node][feature]), cut, gain)
        m.stats[left], m.stats[right] = low, high
        m.siblings[left], m.siblings[right] = (node, right), (node, left)
        split_nodes |= {node}
        if m.tree.depth[left] < plan.max_depth:
            m.open += [left, right]
    if plan.growth == "leaf":
        m.open = [n for n in m.open if n not in split_nodes]
        if not splits:
            m.open = []
    else:
        m.open = [n for n in m.open if n not in gains]
    return bool(m.open)


def _score(g, h, n, plan: Boosting):
    """Quality of a node; a split gains the scores of its children minus its own."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.criterion == "newton":
            shrunk = np.sign(g) * np.maximum(np.abs(g) - plan.l1, 0.0)
            return np.where(h + plan.l2 > 0, shrunk * shrunk / (h + plan.l2), 0.0)
        if plan.criterion == "variance":
            return np.where(n > 0, g * g / n, 0.0)
        return np.where(h > 0, (g * g + (h - g) * (h - g)) / h, 0.0)


def _gain_table(table: np.ndarray, total, plan: Boosting) -> np.ndarray:
    """Gain of every (feature, cut); -inf where a child would be too small."""
    low = np.cumsum(table, axis=2)
    high = np.asarray(total)[:, None, None] - low
    gain = _score(*low, plan) + _score(*high, plan) - _score(*[np.asarray(t) for t in total], plan) - plan.gamma
    enough = (low[2] >= max(plan.min_rows, 1)) & (high[2] >= max(plan.min_rows, 1))
    enough &= (low[1] >= plan.min_hessian) & (high[1] >= plan.min_hessian)
    return np.where(enough, gain, -np.inf)


def _best_common(gains: dict):
    """(gain, feature, cut) that is best over all open nodes together; empty nodes do not veto."""
    total = sum(np.where(np.isfinite(g), g, 0.0) for g in gains.values())
    possible = np.any([np.isfinite(g) for g in gains.values()], axis=0)
    total = np.where(possible, total, -np.inf)
    place = np.unravel_index(int(np.argmax(total)), total.shape)
    return (float(total[place]), int(place[0]), int(place[1])) if total[place] > 1e-12 else None


def _close_tree(m: _Member, plan: Boosting) -> None:
    """Set the leaf values of the grown tree and add it to the ensemble."""
    tree = m.tree
    if plan.loss == "exponential":
        leaves = {leaf: m.stats[leaf] for leaf in tree.leaves()}
        weight = sum(h for _, h, _ in leaves.values())
        error = sum(min(g, h - g) for g, h, _ in leaves.values()) / weight if weight else 0.5
        if error >= 0.5:
            m.done = True
            return
        perfect = error <= 0
        alpha = 1.0 if perfect else plan.rate * math.log((1.0 - error) / error)
        for leaf, (g, h, _) in leaves.items():
            tree.value[leaf] = alpha if g > h - g else -alpha
        m.done = perfect
    else:
        for leaf in tree.leaves():
            g, h, _ = m.stats[leaf]
            shrunk = math.copysign(max(abs(g) - plan.l1, 0.0), g)
            tree.value[leaf] = -plan.rate * shrunk / (h + plan.l2) if h + plan.l2 > 1e-150 else 0.0
    m.trees.append(tree)


def score_folds(rows: DataFrame, models: list[BoostedModel]) -> DataFrame:
    """Validation rows of every fold scored by the model of that fold (fold numbers from 1)."""
    width, folds = len(models[0].features), len(models)
    parts = [(m.prior, m.trees, m.loss, _vote_weight(m.trees)) for m in models]

    def task(batches):
        for b in (b for batch in batches for b in _blocks(batch, width, folds)):
            for f, (prior, trees, loss, votes) in enumerate(parts):
                at = np.flatnonzero((b.valid >> f) & 1 == 1)
                if not len(at):
                    continue
                margin = prior + margin_of(trees, np.ascontiguousarray(b.bins[f][:, at]).T)
                p = _probability(loss, margin, votes)
                hit = margin > 0 if loss == "squared" else p > 0.5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids[at]), pa.array(np.full(len(at), f + 1, dtype=np.int32)), pa.array(b.y[at]),
                        pa.array(margin), pa.array(p), pa.array(hit.astype(np.int32)),
                    ],
                    names=["ROW_ID", "fold", "y", "margin", "p1", "prediction"],
                )

    return rows.mapInArrow(task, SCORED_SCHEMA)
