"""Operator 10: document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points.  Every level names
runs of equal symbols, reduces neighbouring symbols to few labels by
deterministic coin tossing (twice the lowest differing bit's place, plus that
bit), cuts phrases at the local maxima of the labels and names each phrase by
a hash of its symbols; the names are the next level's symbols.  A cut depends
on a few symbols around it only, so equal substrings get the same phrases
inside, wherever they stand.

The fingerprint keeps, for each of three levels, slots of minimum hashes over
the set of phrase names (one permutation: a name belongs to one slot of its
level).  The likeness of two fingerprints is the share of equal slots among
those that either fills, which estimates how many phrases two texts share.

Fingerprint format: 4 hex digits per slot, ``....`` for an empty slot.

Defined results: NULL or empty text: all slots empty; two such fingerprints have likeness 1, one of
them and any other 0.  Very long texts are parsed whole.  Equal ``doc_id`` stand next to each other in the
order of their texts; NULL ``doc_id`` comes first.  An empty table gives an empty result; a single document is its own successor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import slices
from tidepanel.llm.common import partitions_for

# Slots of the levels 1, 2 and 3 (phrases of about 3, 8 and 20 characters).
SLOTS = (16, 48, 64)
EMPTY = 0xFFFFFFFF
_M1, _M2, _POWER = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _tossed(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing; neighbours stay different.  ``first`` marks the first symbol of each text."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[:1] = 0
    # The first symbol tosses against its own complement in the lowest bit.
    before[first] = labels[first] ^ labels.dtype.type(1)
    differ = labels ^ before
    lowest = differ & (~differ + labels.dtype.type(1))
    place = np.bitwise_count(lowest - labels.dtype.type(1))
    return (place * 2 + ((labels & lowest) != 0)).astype(np.uint8)


def parsed(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and where each text starts among them.

    ``symbols`` holds the texts one after the other; ``starts`` their first
    places, with the total length at the end.  Empty texts stay empty.
    """
    n = len(symbols)
    if not n:
        return symbols.astype(np.uint64), starts
    text_first = np.zeros(n + 1, bool)
    text_first[starts[:-1]] = True
    text_first = text_first[:n]
    # Runs of equal symbols become one symbol, named by symbol and length.
    begins = text_first.copy()
    begins[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(begins)
    length = np.diff(at, append=n).astype(np.uint64)
    names = mixed(symbols[at].astype(np.uint64) * _POWER + length)
    first = text_first[at]
    # 64-bit names -> labels below 128, below 14, below 8: neighbours always differ.
    labels = _tossed(_tossed(_tossed(names, first), first), first)
    m = len(at)
    # Cut before local maxima; the ends of a text count as lower.
    cut = first.copy()
    if m > 2:
        inner = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
        cut[1:-1] |= inner
    # A text's second symbol never opens a phrase: phrases have two symbols at least, but for one-symbol texts.
    cut[1:] &= ~(first[:-1] & ~first[1:])
    where = np.flatnonzero(cut)
    inside = np.arange(m) - np.repeat(where, np.diff(where, append=m))
    spread = names * (mixed(inside.astype(np.uint64) + _POWER) | np.uint64(1))
    phrase = mixed(np.add.reduceat(spread, where))
    # Where the texts start among runs, then among phrases.
    run_count = np.concatenate([[0], np.cumsum(begins)])[starts]
    return phrase, np.concatenate([[0], np.cumsum(cut)])[run_count]


def sketches(texts: list[str]) -> np.ndarray:
    """One row of slots (32-bit, ``EMPTY`` where no phrase fell) per text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
    symbols = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64)
    out = np.full((len(texts), sum(SLOTS)), EMPTY, np.uint32)
    base = 0
    for slots in SLOTS:
        symbols, starts = parsed(symbols, starts)
        if len(symbols):
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            slot = base + ((symbols >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)
            cell = owner * out.shape[1] + slot
            np.minimum.at(out.reshape(-1), cell, np.minimum(symbols & np.uint64(0xFFFFFFFF), np.uint64(EMPTY - 1)).astype(np.uint32))
        base += slots
    return out


def rendered(slots: np.ndarray) -> list[str]:
    """Four hex digits per slot: the minimum's low bits, which are as random as the minimum is rare."""
    short = (slots & 0xFFFF).astype(">u2").view(np.uint8).reshape(len(slots), -1)
    found = [row.tobytes().hex() for row in short]
    empty = slots == EMPTY
    for i in np.flatnonzero(empty.any(axis=1)).tolist():
        cells = [found[i][4 * k : 4 * k + 4] for k in range(slots.shape[1])]
        found[i] = "".join("...." if e else c for e, c in zip(empty[i].tolist(), cells))
    return found


def likeness(left: str, right: str) -> float:
    """Share of equal slots among those that either fingerprint fills; 1 when both are empty."""
    a = [left[k : k + 4] for k in range(0, len(left), 4)]
    b = [right[k : k + 4] for k in range(0, len(right), 4)]
    filled = [(x, y) for x, y in zip(a, b) if x != "...." or y != "...."]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def _likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = (a != EMPTY) | (b != EMPTY)
    same = filled & ((a & 0xFFFF) == (b & 0xFFFF)) & ((a == EMPTY) == (b == EMPTY))
    total = filled.sum(axis=1)
    return np.where(total > 0, same.sum(axis=1) / np.maximum(total, 1), 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""

    def batches(source):
        for batch in source:
            for first, run in slices(batch.column(1), 2_000_000):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(run)), pa.array(rendered(sketches(run)), pa.string())], names=["doc_id", "fingerprint"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document with the text of the next one by ``doc_id`` (after the last: the first).

    Ranges of ``doc_id`` are cut at quantiles, and the rows of each range are
    sorted by themselves.  The first document of every range also goes to the range before it as a
    guest, so no row has to look into another range.  Ranges and their first ids are as
    many as the shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = partitions_for(spark)
    found = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], F.lit(10_000))).first()[0] if count > 1 else None
    bounds = sorted(set(found or []))
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    # Number of bounds at or below the id; NULL ids belong to the first range.
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))).cast("int") if bounds else F.lit(0)
    rows = docs.withColumn("bucket", bucket)
    # First row of each range, by id then text; a handful of values.
    heads = sorted(
        (r["bucket"], r["first_id"])
        for r in docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first_id")).collect()
    )
    if not heads:
        return docs.withColumn("next_text", F.col("text"))
    before = [heads[k - 1][0] for k in range(len(heads))]
    hosts = F.create_map(*[F.lit(x) for pair in zip([b for b, _ in heads], before) for x in pair])
    firsts = F.create_map(*[x for b, i in heads for x in (F.lit(b), F.lit(i).cast("bigint"))])
    is_head = F.coalesce("doc_id", F.lit(-(1 << 63))) == F.element_at(firsts, F.col("bucket"))
    last = heads[-1][0]
    # Guests of the last range come from the first one, after all of its own rows; elsewhere ids keep the order.
    seats = F.when(
        is_head,
        F.array(
            F.struct(F.col("bucket").alias("seat"), F.lit(0).alias("guest")),
            F.struct(F.element_at(hosts, F.col("bucket")).alias("seat"), F.lit(1).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("seat"), F.lit(0).alias("guest"))))
    seated = rows.withColumn("at", F.explode(seats)).select("doc_id", "text", "at.seat", "at.guest")
    order = Window.partitionBy("seat").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return seated.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").drop("seat", "guest")


def op10_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    docs = with_next(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"))
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("n_chars", n).withColumn("edited", F.concat(F.left("text", n.cast("int") - half), F.left("next_text", half)))
    docs = docs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for first, run in slices(batch.column("text"), 1_000_000):
                part = batch.slice(first, len(run))
                own = sketches(run)
                edited = sketches(part.column("edited").to_pylist())
                # The next text is the next row of the batch, but at the end of a run or a range.
                follows = part.column("next_text").to_pylist()
                after = np.roll(own, -1, axis=0)
                other = [i for i, t in enumerate(follows) if i + 1 == len(run) or t != run[i + 1]]
                if other:
                    after[other] = sketches([follows[i] for i in other])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_chars"), part.column("edited_sha256"), pa.array(rendered(own), pa.string()),
                     pa.array(rendered(edited), pa.string()), pa.array(_likenesses(own, edited)), pa.array(_likenesses(own, after))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return docs.select("doc_id", "n_chars", "edited_sha256", "text", "edited", "next_text").mapInArrow(
        batches, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
