"""Operator 11: exact dedup by recipes of content-defined chunks.

A normalised text (A-Z lower-cased) is cut where three neighbouring bytes fall into given classes, so the cuts depend on content alone.
Every chunk has a 128-bit name.  The contents of all distinct chunks are shuffled once, by name, to verify that no
name stands for two contents; should one, all names are made anew with the next seed.  A text's recipe is the ordered
list of its chunks' verified names: texts are equal exactly when their recipes are.  Only recipes are grouped
and joined; no document moves.  DataFrame operations only.

Of equal texts the row with the largest ``doc_id`` stays; NULL ids come last, and of rows with the same id one stays.

Defined results: NULL text counts as empty, and all empty texts are equal.  Very long texts: a recipe is about a fortieth of
its text, and chunks have ``LONGEST`` bytes at most.  Repeated rows: one stays.  Empty table: empty
result.  Other columns are not read by ``decisions``; ``one_of_each`` hands them through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower, stored

SHORTEST, LONGEST = 512, 4096
SEEDS = 8
# Upper and title case beyond A-Z, and characters that one of the two case tables may not know yet.
_OTHER_CASE = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]"


def normalised(text: Column) -> Column:
    """A-Z in lower case, NULL empty; the plain ``lower`` does it wherever nothing else has another case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(_OTHER_CASE), ascii_lower(text)).otherwise(F.lower(text))


def cut_pattern(shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    """A chunk ends with three bytes that leave the remainders 1, 2, 3 modulo 4, about one place in 64, or at ``longest``."""
    classes = ["".join(f"\\x{b:02x}" for b in range(256) if b % 4 == r) for r in (1, 2, 3)]
    ending = "".join(f"[{c}]" for c in classes)
    return f"(?s).{{{shortest - 3},{longest - 3}}}?{ending}|.{{1,{longest}}}"


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a normalised text in order; each byte is one character from U+0000 to U+00FF."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(cut_pattern(shortest, longest)), F.lit(0))


def _halves(chunk: Column, seed: int, bits: int) -> list[Column]:
    """The two words of a chunk's name; ``bits`` below 64 makes clashes likely, for tests."""
    words = [F.xxhash64(F.lit(2 * seed + k), chunk) for k in (0, 1)]
    return words if bits == 64 else [w.bitwiseAND((1 << bits) - 1) for w in words]


def clashes(texts: DataFrame, seed: int, bits: int, **sizes: int) -> DataFrame:
    """Names that stand for more than one content; copies collapse before the one shuffle of contents."""
    pieces = texts.select(F.explode(chunks(normalised(F.col("text")), **sizes)).alias("piece"))
    left, right = _halves(F.col("piece"), seed, bits)
    contents = pieces.select(left.alias("a"), right.alias("b"), F.encode("piece", "ISO-8859-1").alias("content")).distinct()
    return contents.groupBy("a", "b").count().where("count > 1").select("a", "b")


def verified_seed(texts: DataFrame, bits: int = 64, **sizes: int) -> int:
    """The first seed under which every distinct chunk has a name of its own."""
    for seed in range(SEEDS):
        if clashes(texts, seed, bits, **sizes).isEmpty():
            return seed
    raise RuntimeError(f"chunks share names under {SEEDS} seeds")


def recipes(docs: DataFrame, bits: int = 64, **sizes: int) -> DataFrame:
    """uid (of the row), doc_id, recipe (names in order), text_sha256."""
    texts = docs.select("doc_id", "text")
    seed = verified_seed(texts, bits, **sizes)
    text = normalised(F.col("text"))
    names = F.flatten(F.transform(chunks(text, **sizes), lambda c: F.array(*_halves(c, seed, bits))))
    return texts.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        names.alias("recipe"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )


def decisions(docs: DataFrame, bits: int = 64, **sizes: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Equal recipes are summed before the shuffle; rows of a large group meet their
    group in a join that Spark splits.
    """
    rows = stored(recipes(docs, bits, **sizes), "recipes").withColumn("mark", F.xxhash64("recipe"))
    best = F.max(F.struct("doc_id", (-F.col("uid")).alias("first")))
    groups = rows.groupBy("mark", "recipe").agg(best.alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, ["mark", "recipe"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == -F.col("keep.first")).alias("kept"),
        "text_sha256",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = decisions(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    packed = docs.select(F.struct("*").alias("row"), F.sha2(normalised(docs["text"]).cast("binary"), 256).alias("sha256"), docs["doc_id"].cast("bigint").alias("id"))
    same = (packed["sha256"] == kept["kept_sha256"]) & packed["id"].eqNullSafe(kept["kept_id"])
    return packed.join(kept, same, "left_semi").dropDuplicates(["sha256", "id"]).select("row.*")


def op11_chunk_dedup(spark: SparkSession, root: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{root}/documents.parquet"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
