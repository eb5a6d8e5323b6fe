"""Operator 13: ranked lexical search, term at a time with limited accumulators.

One pass over the texts writes for each document its length and the counts of those terms that some item may ask for (a bitmap of
fixed size tells; its few false answers go in the join with the asked terms).  Per term, document frequency and largest contribution follow.

Terms are taken rarest first, in classes of document frequency.  After each class the k documents with the best partial scores
are completed from their own term lists, and the lowest of the k results is compared
with the sum of the largest contributions of the remaining terms: once these cannot reach it, no document without
an accumulator can be among the best and the item opens no more.  Accumulators that still can are then completed exactly.
Nothing is estimated: a bound is only ever compared from the safe side.

Scores are 64-bit integers, divisions round down; equal scores are ordered by ``doc_id``, NULL last.

Defined results: NULL or empty text, or a text without a term: not counted, never found.  Very long texts are counted piece by piece.
Repeated rows are documents of their own; items with NULL or repeated ids are ranked on their own.  No documents or
no items: empty result.  Other columns are not read.  Terms are named by 64 bits: with 1e5 asked and 1e9 different terms
in the corpus, two of them share a name with a probability of 1e-5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import stored
from tidepanel.llm.words import CODES, span_names

BEST = 20
CLASSES, STEP = 4, 8  # each class takes terms of STEP times the frequency
BITS = 23
PIECE = 1_000_000
# Fixed value: what parts terms.
_PARTING = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_TERM_BYTE = np.array([not _PARTING.match(chr(b)) if b < 128 else True for b in range(256)])
_LOWER = CODES.copy()
_LOWER[ord("A") : ord("Z") + 1] = CODES[ord("a") : ord("z") + 1]
LISTS = "uid bigint, id bigint, n bigint, names array<bigint>, counts array<bigint>"


def term_names(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the terms in UTF-8 bytes."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], _TERM_BYTE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_names(data, starts, ends, _LOWER).view(np.int64), starts


def _pieces(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, piece): long texts are cut where a term ends."""
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        at = 0
        while len(text) - at > PIECE:
            cut = _PARTING.search(text, at + PIECE)
            if cut is None:
                break
            yield i, text[at : cut.end()]
            at = cut.end()
        yield i, text[at:]


def _count(rows: np.ndarray, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum counts of equal (row, name), in order of row and name."""
    order = np.lexsort((names, rows))
    rows, names = rows[order], names[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (names[1:] != names[:-1])])[: len(rows)])
    return rows[new], names[new], np.add.reduceat(counts[order], new) if len(new) else counts[:0]


def count_terms(texts: pa.Array, asked: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(terms per row with repeats, [row, name, count] of the terms that ``asked`` lets through)."""
    total, found = np.zeros(len(texts), np.int64), []

    def close(run: list[tuple[int, bytes]]) -> None:
        bounds = np.cumsum([0, *[len(p) for _, p in run]])
        names, starts = term_names(b"".join(p for _, p in run))
        rows = np.array([i for i, _ in run], np.int64)[np.searchsorted(bounds, starts, "right") - 1]
        np.add.at(total, rows, 1)
        if asked is not None:
            bit = names & ((1 << BITS) - 1)
            hit = (asked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            rows, names = rows[hit], names[hit]
        found.append(_count(rows, names, np.ones(len(rows), np.int64)))

    run, size = [], 0
    for i, piece in _pieces(texts):
        run.append((i, piece.encode("utf-8", "surrogatepass") + b" "))
        size += len(piece)
        if size >= PIECE:
            close(run)
            run, size = [], 0
    close(run)
    return total, list(_count(*[np.concatenate(c) for c in zip(*found)]))


def _list_batches(asked: np.ndarray | None):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not len(batch):
                continue
            total, (rows, names, counts) = count_terms(batch.column(2), asked)
            offsets = pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())) for values in (names, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), *lists], names=["uid", "id", "n", "names", "counts"])

    return batches


def term_lists(texts: DataFrame, id_column: str, asked: np.ndarray | None = None) -> DataFrame:
    """uid (of the row), id, n (terms with repeats), names and counts of its terms, by name."""
    rows = texts.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_list_batches(asked), LISTS)


def bitmap(lists: DataFrame) -> np.ndarray:
    """2**BITS bits, one set for each asked name; at most 2**(BITS - 3) rows come to the driver."""
    bits = lists.select(F.explode("names").alias("name")).select(F.col("name").bitwiseAND((1 << BITS) - 1).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("bits"))
    table, held = np.zeros(1 << (BITS - 3), np.uint8), rows.toArrow()
    table[held["byte"].to_numpy()] = held["bits"].to_numpy()
    return table


# What a term gives in a document before its weight; integers throughout, divisions round down.
_PART = "(1000000000L * {count}) div (1000L * {count} + 12L * m)"


def postings(lists: DataFrame) -> DataFrame:
    """uid, name, part for lists with the length factor ``m``."""
    rows = lists.select("uid", "m", F.explode(F.arrays_zip("names", "counts")).alias("t"))
    return rows.select("uid", F.col("t.names").alias("name"), F.expr(_PART.format(count="t.counts")).alias("part"))


def _best(scores: DataFrame, k: int, *ties) -> DataFrame:
    """The k best rows of each item, numbered by ``rank``."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _completed(started: DataFrame, lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """item, uid, score with the terms of all classes, for rows (item, uid, score, class) that hold the classes up to ``class``.

    A row takes the item's terms to the document's list and looks them up there, so no list is spread out.
    """
    terms = wanted.groupBy("item").agg(F.collect_list(F.struct("name", "weight", "class")).alias("terms"))
    held = lists.join(started.select("uid").distinct(), "uid", "left_semi").select("uid", "m", "names", "counts")
    rows = started.join(terms, "item").select("item", "uid", "score", F.expr("filter(terms, t -> t.class > class)").alias("late")).join(held, "uid")
    part = _PART.format(count="get(counts, cast(array_position(names, t.name) as int) - 1)")
    rest = F.expr(f"aggregate(late, 0L, (a, t) -> a + coalesce(t.weight * ({part}), 0L))")
    return rows.select("item", "uid", (F.col("score") + rest).alias("score"))


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents with a score above 0 for every row of ``items``."""
    spark = docs.sparkSession
    asked = stored(term_lists(items, "item_id"), "items")
    lists = stored(term_lists(docs, "doc_id", bitmap(asked)), "term-lists")
    n_docs, n_terms = lists.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    lists = lists.withColumn("m", F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L"))
    lists_in = postings(lists)
    frequency = lists_in.groupBy("name").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    wanted = asked.select(F.col("uid").alias("item"), F.explode(F.arrays_zip("names", "counts")).alias("t")).select("item", "t.names", "t.counts")
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    group = F.lit(CLASSES - 1)
    for c in reversed(range(CLASSES - 1)):
        group = F.when(F.col("df") * STEP ** (CLASSES - 1 - c) <= n_docs, F.lit(c)).otherwise(group)
    wanted = wanted.withColumnsRenamed({"names": "name", "counts": "times"}).join(frequency, "name")
    wanted = stored(wanted.select("item", "name", (F.col("times") * weight).alias("weight"), (F.col("times") * weight * F.col("most")).alias("bound"), group.alias("class")), "terms")
    ahead = F.sum("bound").over(Window.partitionBy("item").orderBy(F.col("class").desc()))
    rests = wanted.groupBy("item", "class").agg(F.sum("bound").alias("bound")).select("item", "class", ahead.alias("rest"))
    inverted = stored(lists_in.join(wanted.select("name", "class").distinct(), "name"), "inverted", "class")
    open_items = wanted.select("item").distinct()
    scores = spark.createDataFrame([], "item bigint, uid bigint, score bigint")
    finished: list[DataFrame] = []
    for c in range(CLASSES):
        terms = wanted.where(F.col("class") == c).join(open_items, "item").select("item", "name", "weight")
        new = inverted.where(F.col("class") == c).join(terms, "name").select("item", "uid", (F.col("weight") * F.col("part")).alias("score"))
        scores = stored(scores.union(new).groupBy("item", "uid").agg(F.sum("score").alias("score")), "accumulators")
        # What the classes after this one can still give, against the lowest of the best when they are complete.
        rest = rests.where(F.col("class") > c).groupBy("item").agg(F.max("rest").alias("rest"))
        leaders = stored(_best(scores, best, "uid").select("item", "uid", "score", F.lit(c).alias("class")), "leaders")
        kth = _completed(leaders, lists, wanted).groupBy("item").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == best)
        state = open_items.join(rest, "item", "left").join(kth, "item", "left")
        state = stored(state.select("item", F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("kth", F.lit(0)).alias("kth")), "state")
        shut = state.where("rest = 0 OR rest < kth")
        finished.append(scores.join(shut, "item").where("score + rest >= kth").select("item", "uid", "score", F.lit(c).alias("class")))
        open_items = state.where("rest > 0 AND rest >= kth").select("item")
        scores = scores.join(open_items, "item", "left_semi")
        if open_items.isEmpty():
            break
    alive = finished[0]
    for more in finished[1:]:
        alive = alive.union(more)
    alive = stored(alive, "survivors")
    total = _completed(alive, lists, wanted).where("score > 0").join(lists.select("uid", F.col("id").alias("doc_id")), "uid")
    top = _best(total, best, F.col("doc_id").asc_nulls_last(), "uid")
    names = asked.select(F.col("uid").alias("item"), F.col("id").alias("item_id"))
    return top.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    return search(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate({0}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format('documents')} AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS.format('benchmark')} AS term FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term),
parts AS (
  SELECT t.doc_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * l.n * c.nn) // c.ll))) AS part
  FROM tf t JOIN w ON w.term = t.term JOIN lengths l ON l.doc_id = t.doc_id, corpus c),
scores AS (SELECT q.item_id, p.doc_id, sum(q.times * p.part)::BIGINT AS score FROM q JOIN parts p ON p.term = q.term GROUP BY q.item_id, p.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {BEST}
"""
