"""Operator 2: mixing sources to target weights.

Documents get hash-random keys.  Keys cut each source into ranges, the sizes of
the ranges are summed (partial sums before the shuffle), and a running sum over
the ranges of a source finds the one in which its budget ends.  Only that range
is sorted row by row, so no task ever holds a source.  A budget above the size
of its source repeats whole epochs and cuts the last one.  DataFrame operations
only.

Defined results: NULL text or no words: size 0, nothing taken.  NULL source: a
source of its own, after all others.  NULL or repeated ``doc_id``: allowed; rows
with equal id and size may swap their shares.  One source, an empty table or
targets above what the sources hold: each source ends at ``max_epochs`` times
its size.  Source columns named like working columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, n_words, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
RANGES = 1 << 14
SEED = "mix-1"
_KEY_BITS = 60


def sized(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, source, size and the random key; the text is left behind."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10)
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.cast("bigint").alias("mix_key"), *extra)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Water filling: sources ordered by size per weight; those whose proportional
    share exceeds ``max_epochs`` times their size stop there, and the rest is
    shared anew by weight.  In that order the stopped sources are a prefix, so
    one running sum finds them all at once.  The running sums go over one row per
    source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(max_epochs))
    rows = sizes.withColumn("weight", weight).withColumn("limit", limit)
    every = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    # Left over for this source and all later ones if all earlier ones stop at their limit.
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stops = (F.col("budget") - F.col("spent")) * F.col("weight") >= F.col("limit") * F.col("weight_left")
    rows = rows.withColumn("stops", stops)
    free_budget = F.first("budget").over(every) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(every), F.lit(0.0))
    free_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every)
    target = F.when(F.col("stops"), F.col("limit")).otherwise(free_budget * F.col("weight") / free_weight)
    return rows.withColumn("target", target).select("source", "source_size", "target")


def range_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What each range (source, key_range) needs to know about its source's budget.

    epochs: whole passes; rest: words of the last pass; before: words of the source in earlier
    ranges; is_in: the last pass takes all of the range; is_cut: the budget ends inside it.
    """
    per_range = stored(rows.groupBy("source", "key_range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.floor(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size")
    )
    upto = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per_range.withColumn("before", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).cast("bigint"))
    plan = before.join(targets, before["source"].eqNullSafe(targets["source"])).select(
        before["source"].alias("plan_source"),
        F.col("key_range").alias("plan_range"),
        *["source_size", "target", "epochs", "rest", "before"],
        (F.col("before") + F.col("range_size") <= F.col("rest")).alias("is_in"),
        ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("range_size") > F.col("rest"))).alias("is_cut"),
    )
    return stored(plan, "mix-plan")


def _partly(joined: DataFrame, keep: list[str], *ties) -> DataFrame:
    """Shares in the ranges that are cut: a running sum over the rows of one range."""
    running = Window.partitionBy("source", "key_range").orderBy("mix_key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    share_of = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return joined.select(*keep, (F.col("size") * F.col("epochs") + share_of).cast("bigint").alias("taken"))


def _ranged(docs: DataFrame, ranges: int, *extra: str) -> DataFrame:
    return sized(docs, *extra).withColumn("key_range", F.expr(f"mix_key div {(1 << _KEY_BITS) // ranges}"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    ``taken`` counts words; per source it adds up to ``floor(target)`` exactly.
    ``ranges`` bounds the rows that one window sorts: a source of n documents
    has about n / ranges in the range that is cut.  Rows meet the plan by (source, range), so a
    source with a third of all rows is dealt out over all its ranges.
    """
    rows = stored(_ranged(docs, ranges), "mix-sizes")
    plan = range_plan(rows, weights, share, max_epochs)
    joined = rows.join(plan, rows["source"].eqNullSafe(F.col("plan_source")) & (F.col("key_range") == F.col("plan_range")))
    columns = ["doc_id", "size", "source_size", "target"]
    taken = (F.col("size") * (F.col("epochs") + F.col("is_in").cast("int"))).cast("bigint")
    whole = joined.where(~F.col("is_cut")).select(*columns, taken.alias("taken"))
    return whole.unionByName(_partly(joined.where("is_cut"), columns))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, ranges: int = RANGES) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every epoch that takes a document, the last one cut to the words it takes.

    Texts meet one plan row per source, which Catalyst broadcasts while it is
    small; only the texts of the ranges that are cut are shuffled.  Documents of which nothing is taken are not in the mix.
    """
    body = F.struct(*[F.col(c) for c in docs.columns])
    rows = _ranged(docs.withColumn("mix_body", body), ranges, "mix_body")
    plan = range_plan(stored(_ranged(docs, ranges), "mix-sizes"), weights, share, max_epochs)
    cut = plan.where("is_cut").select("plan_source", "plan_range", "epochs", "rest", "before")
    per_source = stored(
        plan.groupBy("plan_source").agg(
            F.first("epochs").alias("epochs"),
            F.coalesce(F.max(F.when(F.col("is_in"), F.col("plan_range"))), F.lit(-1)).alias("last_in"),
            F.coalesce(F.max(F.when(F.col("is_cut"), F.col("plan_range"))), F.lit(-1)).alias("cut_range"),
        ),
        "mix-sources",
    )
    same_source = rows["source"].eqNullSafe(F.col("plan_source"))
    whole = rows.join(per_source, same_source).where("key_range != cut_range")
    whole = whole.select("mix_body", "size", (F.col("size") * (F.col("epochs") + (F.col("key_range") <= F.col("last_in")).cast("int"))).alias("taken"))
    partly = _partly(rows.join(cut, same_source & (F.col("key_range") == F.col("plan_range"))), ["mix_body", "size"], "mix_body.text", F.xxhash64("mix_body"))
    taken = whole.unionByName(partly).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    each = taken.withColumn("copy", copies).withColumn("left", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    # White space stays as it was: every piece is a word with what precedes it.
    pieces = F.regexp_extract_all("mix_body.text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), 0)
    text = F.when(F.col("left") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("left").cast("int")), "")).otherwise(F.col("mix_body.text"))
    each = each.withColumn("mix_text", text)
    out = {c: F.col(f"mix_body.`{c}`") for c in docs.columns} | {"text": F.col("mix_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("left") < F.col("size"), F.length("mix_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("mix_body.n_chars"))
    return each.select(*[out[c].alias(c) for c in docs.columns])


def op2_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    return mix(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "source", "text"))


# The same shares by plain running sums; fine for one machine.
OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS mix_key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([{', '.join(f'{float(w)}' for w in WEIGHTS)}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight,
    source_size * {float(MAX_EPOCHS)}::DOUBLE AS lim, {SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
  FROM sources),
ordered AS (
  SELECT *, coalesce(sum(lim) OVER w, 0.0) AS spent,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, (budget - spent) * weight >= lim * weight_left AS stops FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN lim ELSE
    (budget - coalesce(sum(CASE WHEN stops THEN lim END) OVER (), 0.0)) * weight / sum(CASE WHEN NOT stops THEN weight END) OVER () END AS target
  FROM stopped),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM run
"""
