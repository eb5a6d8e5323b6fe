"""Operator 4: quality classifier, a factorisation machine.

Inputs of a score are hashed words, statistics of the text's structure and the
declared length of the document; labels, language, source and id are not.  The
score of a row x is

    w0 + w.x + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

the sum-of-squares form of all pairwise interactions, linear in the number of
filled inputs.  It is learned by AdaGrad on a bounded sample of labelled rows
(``SAMPLE`` rows with the smallest hash of their id, a documented parameter);
every document is scored, in batches, without a shuffle.

Defined results: NULL or empty text: scored from its structure (all counts zero).
NULL ``doc_id``: scored; its remainder is that of the empty string.  No labels at
all, or one class only: the constant score of the prior.  Rows repeated in the documents are
scored one by one, and learning takes one of those with the same id; rows repeated in the labels count as often in learning.
NULL labels are skipped.  Very long texts are read whole, as a run of their own.  An empty table of documents gives an empty
result.  Other columns are not read by ``classify``, whatever their names; ``accepted`` hands them through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.bpe import slices
from tidepanel.llm.common import of_stage

SAMPLE = 8192
BUCKETS = 1 << 13
FACTORS = 8
EPOCHS = 6
CACHE_WORDS = 100_000
RUN = 500_000  # characters that are scored at a time
STATS = (
    "upper", "digit", "symbol", "space", "line_feed", "high_byte", "sentence_end", "word_length", "distinct_words",
    "distinct_lines", "log_words", "longest_word", "log_declared", "empty",
)


class _Buckets(dict):
    """word -> bucket, filled on demand."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        kinds[b] = ["A" <= c <= "Z", "0" <= c <= "9", 33 <= b < 127 and not c.isalnum() and c not in ".,;:'-", b in (9, 32), b == 10, b >= 128, c in ".,;:"]
    return kinds


_CLASSES = _byte_classes()


def inputs(text: str, declared: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the distinct hashed words, their weights, statistics) of one document."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _CLASSES / max(1, len(raw))
    words = text.lower().split()
    lines = text.split("\n")
    if words:
        ids, counts = np.unique(np.fromiter(map(of_stage("buckets", _Buckets).__getitem__, words), np.int32, len(words)), return_counts=True)
        weights = np.log1p(counts)
        weights /= np.sqrt((weights**2).sum())
    else:
        ids, weights = np.empty(0, np.int32), np.empty(0)
    n = len(words)
    stats = np.array(
        [*shares, len(raw) / max(1, n), len(ids) / max(1, min(n, BUCKETS)), len(set(lines)) / len(lines), np.log1p(n),
         np.log1p(max(map(len, words), default=0)), np.log1p(max(0, declared or 0)), float(not n)]
    )
    return ids, weights, stats


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (columns, values, first places): words, then standardised statistics."""
        stats = np.clip((np.array([s for _, _, s in found]) - self.mean) / self.scale, -4, 4) / 4
        width, columns, values = stats.shape[1], [], []
        places = BUCKETS + np.arange(width)
        for (ids, weights, _), mine in zip(found, stats):
            columns += [ids, places]
            values += [weights, mine]
        sizes = np.array([len(ids) + width for ids, _, _ in found])
        return np.concatenate(columns), np.concatenate(values), np.concatenate([[0], np.cumsum(sizes)])

    def margin(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the rows, and their factor sums."""
        v = self.factors[columns] * values[:, None]
        sums = np.add.reduceat(v, starts[:-1], axis=0)
        squares = np.add.reduceat((v**2).sum(axis=1), starts[:-1])
        plain = np.add.reduceat(self.linear[columns] * values, starts[:-1])
        return self.bias + plain + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        margin, _ = self.margin(*self.rows(found))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(found: list, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.1, batch: int = 64) -> FactorisationMachine:
    """AdaGrad on log-loss; rows in a seeded random order."""
    rng, width = np.random.default_rng(seed), len(STATS)
    stats = np.array([s for _, _, s in found]) if found else np.zeros((1, width))
    scale = stats.std(axis=0)
    model = FactorisationMachine(
        0.0, np.zeros(BUCKETS + width), rng.normal(0, 0.05, (BUCKETS + width, FACTORS)), stats.mean(axis=0), np.where(scale > 0, scale, 1)
    )
    positive = float(labels.sum())
    model.bias = float(np.log((positive + 1) / (len(labels) - positive + 1)))
    if len(labels) == 0 or positive in (0.0, float(len(labels))):
        model.factors[:] = 0
        return model
    columns, values, starts = model.rows(found)
    seen_w, seen_v, seen_b = np.full(len(model.linear), 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = starts[rows + 1] - starts[rows]
            own = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(starts[rows] - own[:-1], sizes) + np.arange(own[-1])
            cols, vals = columns[pick], values[pick]
            margin, sums = model.margin(cols, vals, own)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(slope, sizes) * vals
            touched, where = np.unique(cols, return_inverse=True)
            g_w = np.bincount(where, each, len(touched)) + 1e-5 * model.linear[touched]
            wide = each[:, None] * (np.repeat(sums, sizes, axis=0) - model.factors[cols] * vals[:, None])
            g_v = np.stack([np.bincount(where, wide[:, f], len(touched)) for f in range(FACTORS)], axis=1) + 1e-5 * model.factors[touched]
            g_b = slope.sum()
            seen_w[touched] += g_w**2
            seen_v[touched] += g_v**2
            seen_b += g_b**2
            model.linear[touched] -= rate * g_w / np.sqrt(seen_w[touched])
            model.factors[touched] -= rate * g_v / np.sqrt(seen_v[touched])
            model.bias -= rate * g_b / np.sqrt(seen_b)
    return model


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _declared(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.length("text")).cast("bigint").alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Learn from labelled rows outside the held-out third.

    The sample's ids are picked from ``labels`` alone, so only the sampled
    documents are read into a join; ids and inputs are bounded by ``sample``.
    """
    known = labels.where("quality is not null and doc_id is not null").where(remainder(F.col("doc_id"), 3) != 1)
    # Smallest hashes first; a label without a document only makes the sample smaller.
    picked = known.select(F.col("doc_id").alias("label_id"), "quality").orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for first, run in slices(batch.column("text"), RUN):
                part = batch.slice(first, len(run))
                found = [inputs(t, d) for t, d in zip(run, part.column("n_chars").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label_id"), part.column("quality"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                     pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                    names=["label_id", "quality", "ids", "weights", "stats"],
                )

    texts = docs.select(F.col("doc_id").alias("sampled_id"), F.col("text").cast("string").alias("text"), _declared(docs))
    ids = picked.select("label_id").distinct()
    # One row per sampled id, however often the id repeats: the text with the smallest hash.
    texts = texts.join(F.broadcast(ids), F.col("sampled_id") == F.col("label_id"), "left_semi")
    texts = texts.groupBy("sampled_id").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), F.xxhash64("n_chars"))).alias("row"))
    rows = texts.join(F.broadcast(picked), F.col("sampled_id") == F.col("label_id"))
    rows = rows.select("label_id", F.col("quality").cast("int").alias("quality"), "row.text", "row.n_chars")
    sampled = rows.mapInArrow(batches, "label_id bigint, quality int, ids array<int>, weights array<double>, stats array<double>").toArrow()
    order = np.lexsort([np.array(sampled.column("quality")), np.array(sampled.column("label_id"))]) if sampled.num_rows else np.empty(0, int)
    sampled = sampled.take(pa.array(order))
    found = [
        (np.array(i.values), np.array(w.values), np.array(s.values))
        for i, w, s in zip(sampled.column("ids"), sampled.column("weights"), sampled.column("stats"))
    ]
    return train(found, np.array(sampled.column("quality"), float))


def _scores(machine: FactorisationMachine, texts: pa.Array, declared: pa.Array) -> np.ndarray:
    found = [np.empty(0)]
    for first, run in slices(texts, RUN):
        sizes = declared.slice(first, len(run)).to_pylist()
        found.append(machine.score([inputs(t, d) for t, d in zip(run, sizes)]))
    return np.concatenate(found)


def accepted(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns as they are; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, declared = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes = pc.utf8_length(batch.column(text)) if declared is None else batch.column(declared)
            yield batch.filter(pa.array(_scores(shared.value, batch.column(text), sizes) >= 0.5))

    return docs.mapInArrow(batches, docs.schema)


def classify(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            scores = _scores(shared.value, batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        _declared(docs),
    )
    return rows.mapInArrow(batches, "doc_id bigint, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    return classify(docs, fit(docs, labels))
