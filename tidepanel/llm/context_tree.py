"""Operator 3: language-model scoring by context-tree weighting.

A text is the bytes of its lower-cased (A-Z) form and one end symbol.  A byte
is eight binary decisions; every decision, named by the bits before it, has a
context tree over the bytes that precede it, ``DEPTH`` deep.  A node counts
zeros and ones; its Krichevsky-Trofimov estimate is mixed with that of its
children with the weights of context-tree weighting, at all depths.  The score of a
text is the sum of log10 probabilities of its decisions under the tree of the training
documents, so probabilities of all texts add up to one.

Learning.  Training documents are counted as (context, byte) pairs, per task
first; the pairs are dealt out by their ``ROOT`` nearest context bytes, so a task holds
whole subtrees and weighs them bottom up.  The few levels above the roots are weighed on the
driver; they have at most 256 ** ROOT contexts.  All nodes below stay in the written table.

Scoring.  Up to ``1 << RUN`` rows of a task are a run.  A run asks once for each of its distinct
pairs; questions meet the nodes of their subtrees, are answered there, and go back to the
run's texts, which add up the answers.  Only the levels down to the roots are broadcast.  A context that
training has not seen is read at its deepest ancestor in the whole tree.  Answers are single precision, sums double.
The rows of ``docs`` are read twice and must come in the same tasks and order, as from files; a pair
without an answer stops the query.

Words, for the base score: word counts are exact.  The ``FREQUENT`` most frequent
words (a bounded table) are looked up where the text is read, all others by a join on the word's 64-bit name.

Defined results: NULL or empty text: the end symbol alone.  NULL ``doc_id``: remainder of the empty string.
No training documents: every decision has probability 1/2, base counts are 0.  Very long texts are scored whole,
repeated rows each for itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.bpe import slices
from tidepanel.llm.common import partitions_for, stored
from tidepanel.llm.words import word_names

DEPTH, ROOT = 5, 2
END = 0xFF  # no byte of UTF-8
RUN = 13
CHUNK = 1 << 20
FREQUENT = 1 << 16
HELD_OUT = 10
SLICE = 1_000_000
COUNTED = 2_000_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs of all texts and their ends, as integers with the byte lowest; number of pairs per text."""
    gap = bytes([END]) * DEPTH
    raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = DEPTH + np.concatenate([[0], np.cumsum(lengths + DEPTH - 1)[:-1]])
    packed = raw[: len(raw) - DEPTH].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        packed = (packed << np.uint64(8)) | raw[k : len(raw) - DEPTH + k]
    # Pair at place p of ``packed`` has its byte at p + DEPTH; the places between a text's end and the next text are left out.
    ends = np.cumsum(lengths)
    wanted = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - DEPTH - (ends - lengths), lengths)
    return packed[wanted], lengths


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; relative error below 1e-12 for x >= 0.5."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)


@dataclass
class Level:
    """Nodes of one depth, sorted by key = context bytes, then the bits decided so far after a leading one."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray  # log of the weighted probability
    stay: np.ndarray  # share of a node's own estimate in its mixture; 1 at the deepest level

    @property
    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def decisions(pairs: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth with their zeros and ones, from (context, byte) pairs."""
    pairs = pairs & np.uint64((1 << 8 * (depth + 1)) - 1)
    pairs, where = np.unique(pairs, return_inverse=True)
    counts = np.bincount(where, counts, len(pairs))
    symbol, context = (pairs & np.uint64(255)).astype(np.int64), pairs >> np.uint64(8)
    keys, bits = [], []
    for k in range(8):
        keys.append((context << np.uint64(8)) | ((1 << k) | (symbol >> (8 - k))).astype(np.uint64))
        bits.append((symbol >> (7 - k)) & 1)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    one = np.bincount(where, np.tile(counts, 8) * np.concatenate(bits), len(key))
    return key, np.bincount(where, np.tile(counts, 8), len(key)) - one, one


def parents(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys one level up: the farthest context byte is dropped."""
    return key & np.uint64((1 << 8 * depth) - 1)


def weigh(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: Level | None, depth: int) -> Level:
    own = log_kt(zeros, ones)
    if below is None:
        return Level(key, zeros, ones, own, np.ones(len(key)))
    at = np.searchsorted(key, parents(below.key, depth + 1))
    children = np.bincount(at, below.weighted, len(key))
    return Level(key, zeros, ones, np.logaddexp(own, children) - math.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700))))


def subtree(pairs: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels ROOT..DEPTH of the trees that the pairs belong to."""
    levels: list[Level] = []
    for depth in range(DEPTH, ROOT - 1, -1):
        levels.insert(0, weigh(*decisions(pairs, counts, depth), levels[0] if levels else None, depth))
    return levels


def read_off(levels: list[Level], top: int) -> list[np.ndarray]:
    """Probability of a one at each node if it is the deepest known one, seen from level ``top``."""
    found, gathered, weight = [], np.zeros(len(levels[0].key)), np.ones(len(levels[0].key))
    for k, level in enumerate(levels):
        if k:
            above = levels[k - 1]
            at = np.searchsorted(above.key, parents(level.key, top + k))
            gathered, weight = (gathered + weight * above.stay * above.estimate)[at], (weight * (1 - above.stay))[at]
        found.append(gathered + weight * level.estimate)
    return found


def tagged(key: np.ndarray, depth: int) -> np.ndarray:
    """Node names that are unique over all depths and fit BIGINT."""
    return key | np.uint64((depth + 1) << 56)


def split(pairs: np.ndarray) -> np.ndarray:
    """Part (the ``ROOT`` nearest context bytes) in the upper 32 bits, the rest of the pair in the lower ones."""
    return ((pairs >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1)) << np.uint64(32) | (pairs >> np.uint64(8 * ROOT + 8)) << np.uint64(8) | (pairs & np.uint64(255))


def unsplit(part: int, names: np.ndarray) -> np.ndarray:
    names = names.astype(np.uint64)
    return (names >> np.uint64(8)) << np.uint64(8 * ROOT + 8) | np.uint64(int(part) << 8) | (names & np.uint64(255))


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of equal neighbours."""
    if len(values):
        cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(values)])


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per end, with the bytes of ``values`` up to there."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Model:
    """Nodes, sorted by tagged key, with the final probability of a one; words and their counts."""

    keys: np.ndarray
    ones: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    total: float
    distinct: float
    documents: float

    def log10_costs(self, pairs: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each (context, byte) pair."""
        symbol = (pairs & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(pairs))
        if not len(self.keys):
            return out + 8 * math.log10(0.5)
        for k in range(8):
            prefix = ((1 << k) | (symbol >> (8 - k))).astype(np.uint64)
            bit = (symbol >> (7 - k)) & 1
            p = np.full(len(pairs), 0.5)
            left = np.arange(len(pairs))
            for depth in range(DEPTH, -1, -1):
                context = (pairs[left] >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
                wanted = tagged((context << np.uint64(8)) | prefix[left], depth)
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[at] == wanted
                p[left[hit]] = self.ones[at[hit]]
                left = left[~hit]
                if not len(left):
                    break
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT != 0


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _count_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, part, name, count): kind 0 words, kind 1 (context, byte) pairs, summed over the task as far as memory is bounded."""
    held: dict[int, list] = {0: [], 1: []}

    def flush(kind):
        if not held[kind]:
            return
        keys, counts = _merged(held[kind])
        held[kind] = [(keys, counts)]
        if len(keys) > COUNTED:
            yield from emit(kind)

    def emit(kind):
        for keys, counts in held[kind]:
            part = (keys >> np.uint64(8)) & np.uint64((1 << 8 * ROOT) - 1) if kind else keys & np.uint64(0xFFFF)
            for at in range(0, len(keys), 500_000):
                k = keys[at : at + 500_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), kind, np.int32)), pa.array(part[at : at + 500_000].astype(np.int32)), pa.array(k.view(np.int64)), pa.array(counts[at : at + 500_000])],
                    names=["kind", "part", "name", "n"],
                )
        held[kind] = []

    for batch in source:
        ids = batch.column(0).to_pylist()
        for first, run in slices(batch.column(1), SLICE):
            mine = [t for i, t in zip(ids[first:], run) if _training(i)]
            if not mine:
                continue
            texts = [_lowered(t) for t in mine]
            keys, counts = np.unique(word_names(mine)[0], return_counts=True)
            held[0].append((keys, counts.astype(np.int64)))
            pairs, _ = grams(texts)
            keys, counts = np.unique(pairs, return_counts=True)
            held[1].append((keys, counts.astype(np.int64)))
            for kind in (0, 1):
                if sum(len(k) for k, _ in held[kind]) > COUNTED:
                    yield from flush(kind)
    for kind in (0, 1):
        yield from flush(kind)
        yield from emit(kind)


def _tree_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole subtrees, up to CHUNK of one depth in a row; rows come sorted by part, one part is weighed at a time."""
    part, held = None, []

    def nodes():
        pairs, counts = _merged(held)
        levels = subtree(pairs, counts)
        for k, (level, p) in enumerate(zip(levels, read_off(levels, ROOT))):
            for at in range(0, len(p), CHUNK):
                own = [x[at : at + CHUNK].tobytes() for x in (level.key, p, level.zeros + level.ones, level.ones, level.weighted)]
                if k:
                    own[2:] = [None] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([ROOT + k], pa.int32()), *(pa.array([x], pa.binary()) for x in own)],
                    names=["part", "depth", "keys", "p", "n", "ones", "weighted"],
                )

    for batch in source:
        parts, names, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero(np.diff(parts)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
            if a == b:
                continue
            if parts[a] != part:
                if held:
                    yield from nodes()
                part, held = parts[a], []
            held.append((names[a:b].astype(np.int64).view(np.uint64), counts[a:b]))
            # Counts of one pair from many tasks become one as they come: what is held grows with the distinct pairs only.
            if sum(len(k) for k, _ in held[1:]) > max(COUNTED // 4, len(held[0][0])):
                held = [_merged(held)]
    if held:
        yield from nodes()


@dataclass
class Upper:
    """Levels above ROOT, finished, and what they leave to each root: final = gathered + weight * (probability seen from the root)."""

    keys: np.ndarray  # tagged
    ones: np.ndarray
    roots: np.ndarray
    gathered: np.ndarray
    weight: np.ndarray

    def over(self, depth: np.ndarray, key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tagged keys and final probabilities of these levels and of the nodes below."""
        at = np.searchsorted(self.roots, key & np.uint64((1 << 8 * (ROOT + 1)) - 1))
        keys = np.concatenate([self.keys, key | ((depth + 1).astype(np.uint64) << np.uint64(56))])
        found = np.concatenate([self.ones, self.gathered[at] + self.weight[at] * p])
        order = np.argsort(keys, kind="stable")
        return keys[order], found[order]


def _upper(key: np.ndarray, n: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> Upper:
    """The levels above ROOT are weighed here, from the roots of all subtrees."""
    if not len(key):
        return Upper(key, n, key, n, n)
    order = np.argsort(key)
    ones, n = ones[order], n[order]
    levels = [Level(key[order], n - ones, ones, weighted[order], np.zeros(len(order)))]
    for depth in range(ROOT - 1, -1, -1):
        below = levels[0]
        key, where = np.unique(parents(below.key, depth + 1), return_inverse=True)
        levels.insert(0, weigh(key, np.bincount(where, below.zeros, len(key)), np.bincount(where, below.ones, len(key)), below, depth))
    gathered, weight = np.zeros(len(levels[0].key)), np.ones(len(levels[0].key))
    keys, found = [], []
    for depth, level in enumerate(levels):
        if depth:
            above = levels[depth - 1]
            at = np.searchsorted(above.key, parents(level.key, depth))
            gathered, weight = (gathered + weight * above.stay * above.estimate)[at], (weight * (1 - above.stay))[at]
        if depth < ROOT:
            keys.append(tagged(level.key, depth))
            found.append(gathered + weight * level.estimate)
    return Upper(np.concatenate(keys), np.concatenate(found), levels[-1].key, gathered, weight)


def _finished(roots: pa.Table, nodes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tagged keys and final probabilities of a whole tree in one place."""
    upper = _upper(np.array(roots.column("key"), np.int64).view(np.uint64), *(np.array(roots.column(c), np.float64) for c in ("n", "ones", "weighted")))
    return upper.over(np.array(nodes.column("depth"), np.int64), np.array(nodes.column("key"), np.int64).view(np.uint64), np.array(nodes.column("p"), np.float64))


@dataclass
class Tree:
    """All nodes from the roots down, as written, and the levels above."""

    nodes: DataFrame
    upper: Upper


def learn(docs: DataFrame, frequent: int = FREQUENT) -> tuple[Model, DataFrame, Tree]:
    """The model that is broadcast (levels above the roots, frequent words), the exact word counts (name, n), and the tree."""
    spark = docs.sparkSession
    counted = _texts(docs).mapInArrow(_count_batches, "kind int, part int, name bigint, n bigint")
    counted = stored(counted, "counts")
    vocabulary = stored(counted.where("kind = 0").groupBy("name").agg(F.sum("n").alias("n")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents = docs.where(~held_out(F.col("doc_id"))).count()
    top = vocabulary.orderBy(F.desc("n"), "name").limit(frequent).toArrow()
    pairs = counted.where("kind = 1").select("part", "name", "n").repartition(partitions_for(spark), "part").sortWithinPartitions("part")
    nodes = stored(pairs.mapInArrow(_tree_batches, "part int, depth int, keys binary, p binary, n binary, ones binary, weighted binary"), "tree")
    roots = nodes.where(f"depth = {ROOT}").select("keys", "n", "ones", "weighted").toArrow()
    key, n, ones, weighted = (
        np.frombuffer(b"".join(roots.column(c).to_pylist()), np.uint64 if c == "keys" else np.float64) for c in ("keys", "n", "ones", "weighted")
    )
    upper = _upper(key, n, ones, weighted)
    names = np.array(top.column("name"), np.int64).view(np.uint64)
    order = np.argsort(names)
    model = Model(
        upper.keys, upper.ones, names[order], np.array(top.column("n"), np.float64)[order], float(sums[0] + documents), float(sums[1] + (documents > 0)), float(documents)
    )
    return model, vocabulary, Tree(nodes, upper)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _question_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, part, names): the distinct pairs of each run, one row per part; where they are more than COUNTED, in several goes."""
    run, held = None, []

    def questions():
        wanted = np.unique(np.concatenate(held))
        parts = (wanted >> np.uint64(32)).astype(np.int32)
        starts, ends = np.array(list(stretches(parts))).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ends), run)), pa.array(parts[starts]), binaries(wanted.astype(np.uint32), ends)], names=["run", "part", "names"]
        )

    for batch in source:
        runs = batch.column(0).to_numpy()
        for a, b in stretches(runs):
            if runs[a] != run:
                if held:
                    yield from questions()
                run, held = runs[a], []
            for _, texts in slices(batch.column(1).slice(a, b - a), SLICE):
                held.append(np.unique(split(grams([_lowered(t) for t in texts])[0])))
                if sum(map(len, held)) > COUNTED:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > COUNTED:
                        yield from questions()
                        held = []
    if held:
        yield from questions()


def _answer_batches(shared):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 probabilities of the names asked for; rows come sorted by part, its nodes (run NULL) before its questions."""
        upper: Upper = shared.value
        part, nodes, model = None, [], None
        for batch in source:
            parts = batch.column(0).to_numpy()
            for a, b in stretches(parts):
                if parts[a] != part:
                    part, nodes, model = parts[a], [], None
                first = a + batch.column(1).slice(a, b - a).null_count
                for k in range(a, first):
                    key, p = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((3, np.uint64), (4, np.float64)))
                    nodes.append((np.full(len(key), batch.column(2)[k].as_py()), key, p))
                if first == b:
                    continue
                if model is None:
                    depth, key, p = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)), *nodes))
                    nodes, model = [], Model(*upper.over(depth, key, p), None, None, 1, 1, 1)
                names = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3).slice(first, b - first)]
                distinct, where = np.unique(np.concatenate(names), return_inverse=True)
                costs = model.log10_costs(unsplit(part, distinct)).astype(np.float32)[where]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, b - first) for c in (1, 0, 3)), binaries(costs, np.cumsum([len(x) for x in names]))],
                    names=["run", "part", "names", "costs"],
                )

    return batches


def _answered(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """doc_id and text of rows of one run, with the run's pairs (sorted) and their costs; rows come sorted by run, answers before texts."""
    run, held, pairs, costs = None, [], None, None
    for batch in source:
        runs = batch.column(0).to_numpy()
        for a, b in stretches(runs):
            if runs[a] != run:
                run, held, pairs, costs = runs[a], [], np.empty(0, np.uint64), np.empty(0)
            first = b - batch.column(1).slice(a, b - a).null_count
            for k in range(a, first):
                names = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint32).astype(np.uint64)
                held.append((names | np.uint64(batch.column(1)[k].as_py() << 32), np.frombuffer(batch.column(3)[k].as_py(), np.float32)))
            if first == b:
                continue
            if held:
                pairs, at = np.unique(np.concatenate([x for x, _ in held]), return_index=True)
                costs, held = np.concatenate([x for _, x in held])[at].astype(np.float64), []
            yield batch.column(4).slice(first, b - first), batch.column(5).slice(first, b - first), pairs, costs


def _score_batches(shared):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (name NULL) and of their words outside the frequent table (name set, n times)."""
        model: Model = shared.value
        row = TaskContext.get().partitionId() << 36
        end_score = float(model.base(np.array([model.documents]))[0])
        for ids, column, known_pairs, costs in _answered(source):
            for first, run in slices(column, SLICE):
                texts = [_lowered(t) for t in run]
                pairs, lengths = grams(texts)
                distinct, where = np.unique(split(pairs), return_inverse=True)
                at = np.searchsorted(known_pairs, distinct)
                if not len(known_pairs) or (known_pairs[np.minimum(at, len(known_pairs) - 1)] != distinct).any():
                    raise RuntimeError("a run came with other rows when it was read again; store the documents first")
                each = costs[at][where]
                scores = np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                del pairs, where, each
                names, counts = word_names(run)
                owner = np.repeat(np.arange(len(texts)), counts)
                hit = np.zeros(len(names), bool)
                value = np.zeros(len(names))
                if len(model.words) and len(names):
                    at = np.minimum(np.searchsorted(model.words, names), len(model.words) - 1)
                    hit = model.words[at] == names
                    value[hit] = model.base(model.word_counts[at[hit]])
                base = np.bincount(owner, value, len(texts)) + end_score
                known = np.bincount(owner[hit], minlength=len(texts)) + int(model.documents > 0)
                n = len(texts)
                rows = row + np.arange(n)
                rare = np.stack([rows[owner[~hit]].astype(np.uint64), names[~hit]], axis=1)
                order = np.lexsort([rare[:, 1], rare[:, 0]])
                rare = rare[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]).any(axis=1)
                starts = np.flatnonzero(new)
                times = np.diff(starts, append=len(rare))
                k = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(rows), pa.array(rare[starts, 0].astype(np.int64))]), pa.concat_arrays([ids.slice(first, n), pa.nulls(k, pa.int64())]),
                     pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rare[starts, 1].view(np.int64) if k else np.empty(0, np.int64))]),
                     pa.concat_arrays([pa.array(counts + 1), pa.array(times.astype(np.int64))]), pa.concat_arrays([pa.array(known.astype(np.int64)), pa.nulls(k, pa.int64())]),
                     pa.concat_arrays([pa.array(base), pa.nulls(k, pa.float64())]), pa.concat_arrays([pa.array(scores), pa.nulls(k, pa.float64())])],
                    names=["row", "doc_id", "name", "n", "known", "base", "score"],
                )
                row += n

    return batches


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    shared, upper = (spark.sparkContext.broadcast(x) for x in (model, tree.upper))
    texts = _texts(docs).select(F.shiftright(F.monotonically_increasing_id(), RUN).alias("run"), "doc_id", "text")
    questions = texts.select("run", "text").mapInArrow(_question_batches, "run bigint, part int, names binary")
    asked = questions.selectExpr("part", "run", "CAST(NULL AS INT) AS depth", "names AS keys", "CAST(NULL AS BINARY) AS p")
    asked = asked.union(tree.nodes.selectExpr("part", "CAST(NULL AS BIGINT) AS run", "depth", "keys", "p"))
    asked = asked.repartition(partitions_for(spark), "part").sortWithinPartitions("part", F.col("run").asc_nulls_first())
    answers = asked.mapInArrow(_answer_batches(upper), "run bigint, part int, names binary, costs binary")
    both = texts.selectExpr("run", "CAST(NULL AS INT) AS part", "CAST(NULL AS BINARY) AS names", "CAST(NULL AS BINARY) AS costs", "doc_id", "text")
    both = both.union(answers.selectExpr("*", "CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text"))
    both = both.repartition(partitions_for(spark), "run").sortWithinPartitions("run", F.col("part").asc_nulls_last())
    read = both.mapInArrow(_score_batches(shared), "row bigint, doc_id bigint, name bigint, n bigint, known bigint, base double, score double")
    read = stored(read, "scores")
    words = read.where("name is not null").select("row", "name", F.col("n").alias("times"))
    size = model.total + 0.1 * (model.distinct + 1)
    joined = words.join(vocabulary, "name", "left")
    rare = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1)) / F.lit(size))).alias("rare_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    texts = read.where("name is null").select("row", "doc_id", "n", "known", "base", "score")
    return texts.join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(model.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op3_context_tree(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    return score(docs, *learn(docs))
