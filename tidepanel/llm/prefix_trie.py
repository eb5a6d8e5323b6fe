"""Operator 12: the prefix trie of conversations by ROLLUP over positional columns of turn ids.

Turns are numbered within their conversation, equal turns (role, text) share an id, and every conversation is laid out in
blocks of ``WIDTH`` columns t1..t8.  One ``GROUP BY block's key, ROLLUP (t1, ..., t8)`` aggregates all prefixes of all blocks
together; ``grouping_id`` tells the depth.  A block's key is the node that the prior block ends in, so long
conversations go on in further blocks without further rounds.

Sums over subtrees take a second ROLLUP.  A node belongs to its smallest member; the nodes of one owner are the end of that
conversation's path.  The sum over a subtree is the sum of its members' whole totals, less what the top's owner
owns above the top.

Texts are read once and stay behind: only their digest and word count go on.  Nodes are named by 128 bits, made
of the ids on their path.  Running sums are taken over ranges first, so a conversation of any length is spread over tasks.

Defined results: NULL role or text: empty.  NULL ``turn``: before all others; equal turns are ordered by
digest of role and text.  Repeated rows are turns of their own.  NULL ``conv_id``: one conversation, counted
as a member but without a name.  Very long texts: only digests move.  Empty table: no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import n_words, partitions_for, stored

WIDTH = 8
SPAN = 1024
T = [f"t{i}" for i in range(1, WIDTH + 1)]
W = [f"w{i}" for i in range(1, WIDTH + 1)]
NODE = ["depth", "k1", "k2"]


def before(df: DataFrame, key: str, part: Column, order: list, values: dict[str, Column], how: str = "sum") -> DataFrame:
    """Adds, for each name, ``how`` (sum or bit_xor) of the value over the rows of ``key`` that come earlier; 0 for the first.

    ``part`` rises with ``order``: totals per part are summed first, so no task needs all rows of a key.
    """
    agg = getattr(F, how)
    join = (lambda a, b: a.bitwiseXOR(b)) if how == "bit_xor" else (lambda a, b: a + b)
    df = df.withColumns({"part": part} | {f"of_{n}": v.cast("bigint") for n, v in values.items()})
    ahead = Window.partitionBy("key_").orderBy(F.col("part_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(F.col(key).alias("key_"), F.col("part").alias("part_")).agg(*[agg(f"of_{n}").alias(f"sum_{n}") for n in values])
    totals = totals.select("key_", "part_", *[F.coalesce(agg(f"sum_{n}").over(ahead), F.lit(0)).alias(f"off_{n}") for n in values])
    inside = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(totals, F.col(key).eqNullSafe(F.col("key_")) & F.col("part").eqNullSafe(F.col("part_")))
    found = {n: join(F.col(f"off_{n}"), F.coalesce(agg(f"of_{n}").over(inside), F.lit(0))) for n in values}
    return df.withColumns(found).drop("part", "key_", "part_", *[f"{p}_{n}" for n in values for p in ("of", "off")])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        n_words(text).alias("words"),
    )
    rows = stored(rows, "turns")
    ids = stored(rows.groupBy("digest").agg(F.max("words").alias("words")).withColumn("turn_id", F.monotonically_increasing_id()), "turn-ids")
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    rows = before(rows.drop("words"), "conv_id", F.expr(f"turn div {SPAN}"), order, {"pos": F.lit(1)})
    return rows.join(ids, "digest").select("conv_id", (F.col("pos") + 1).alias("pos"), "turn_id", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, length, pos, turn_id, words after the exchange of beginnings; a turnless conversation is one row with NULL pos.

    Conversation c begins with the first h turns of conversation c - c % 20 and goes on with its own turns after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.withColumns(
        {"h": F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, F.lit(0)), "base": F.expr("conv_id - conv_id % 20")}
    )
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left")
    convs = convs.withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", "lead", "length"), "conversations")
    heads = turns.where("pos <= 3").select(F.col("conv_id").alias("head"), "pos", "turn_id", "words")
    first = convs.join(heads, (F.col("base") == F.col("head")) & (F.col("pos") <= F.col("h")))
    own = turns.withColumnRenamed("conv_id", "own")
    own = convs.join(own, F.col("own").eqNullSafe(F.col("conv_id")) & (F.col("pos") > F.col("h")))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("lead"))
    none = convs.where("length = 0").withColumns({c: F.lit(None).cast("bigint") for c in ("pos", "turn_id", "words")})
    columns = ["conv_id", "length", "pos", "turn_id", "words"]
    return first.select(columns).union(own.select(columns)).union(none.select(columns))


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``rebuilt``."""
    lengths = turns.groupBy(F.col("conv_id").alias("of")).agg(F.max("pos").alias("length"))
    return turns.join(lengths, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "length", "pos", "turn_id", "words")


def _name(columns: list[str | Column]) -> list[Column]:
    """Two independent words; NULLs leave a word as it is, so a prefix has the name of its filled columns."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, length, b, k1, k2 (node that the prior block ends in), t1.., w1..: one row per conversation and block."""
    at = F.coalesce((F.col("pos") - 1) % WIDTH, F.lit(0))
    cells = [F.max(F.when(at == i, F.col(source))).alias(f"{short}{i + 1}") for short, source in (("t", "turn_id"), ("w", "words")) for i in range(WIDTH)]
    table = rows.groupBy("conv_id", "length", F.expr(f"coalesce((pos - 1) div {WIDTH}, 0)").alias("b")).agg(*cells)
    k1, k2 = _name(["b", *T])
    return before(table, "conv_id", F.expr(f"b div {SPAN}"), [F.col("b")], {"k1": k1, "k2": k2}, "bit_xor")


def _prefixes(table: DataFrame, measures: str) -> DataFrame:
    """One row per node: depth, k1, k2, parent's p1, p2 and the measures; ``level`` columns of the block are set."""
    found = table.sparkSession.sql(
        f"""SELECT k1 AS b1, k2 AS b2, b, {', '.join(T)}, {WIDTH} - bit_count(grouping_id()) AS level, {measures}
            FROM {{rows}} GROUP BY k1, k2, b, ROLLUP ({', '.join(T)})""",
        rows=table,
    )
    found = found.where(f"if(level = 0, b = 0, get(array({', '.join(T)}), level - 1) IS NOT NULL)")
    name = _name(["b", *T])
    shorter = _name(["b", *[F.when(F.col("level") > i + 1, F.col(t)) for i, t in enumerate(T)]])
    keys, parents = {}, {}
    for k in (1, 2):
        prior = F.col(f"b{k}")
        keys[f"k{k}"] = prior.bitwiseXOR(name[k - 1])
        above = F.when((F.col("level") == 1) & (F.col("b") > 0), prior).otherwise(prior.bitwiseXOR(shorter[k - 1]))
        parents[f"p{k}"] = F.when((F.col("level") > 0), above)
    found = found.withColumns(keys | parents | {"depth": F.expr(f"b * {WIDTH} + level")})
    return found.drop("b1", "b2", "b", *T)


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids of each node; rows come sorted by node and id, only the running digest is held."""
    node, state = None, None
    for batch in batches:
        done = []
        keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
        ids = batch.column(3).to_pylist()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            now, text = tuple(keys[a].tolist()), ",".join(map(str, ids[a:b])).encode()
            if now == node:
                state.update(b"," + text)
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = now, hashlib.sha256(text)
        if done:
            yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done), kinds)], names=[*NODE, "ends_sha256"])


def ends(table: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of nodes in which conversations end: a digest needs its ids in order, so a node is one task's, read as a stream."""
    last = table.where(f"conv_id IS NOT NULL AND b = if(length = 0, 0, (length - 1) div {WIDTH})")
    names = _name(["b", *T])
    keyed = last.select(F.col("length").alias("depth"), F.col("k1").bitwiseXOR(names[0]).alias("k1"), F.col("k2").bitwiseXOR(names[1]).alias("k2"), "conv_id")
    keyed = keyed.repartition(partitions_for(table.sparkSession), *NODE).sortWithinPartitions(*NODE, "conv_id")
    return keyed.mapInArrow(_digest_runs, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie over rows (conv_id, length, pos, turn_id, words); see the module's head."""
    table = stored(blocks(rows), "blocks")
    measures = f"min(conv_id) AS conv_id, count(*) AS n_convs, {', '.join(f'max({w}) AS {w}' for w in W)}"
    nodes = _prefixes(table, measures)
    words = F.coalesce(F.get(F.array(*W), F.col("level") - 1), F.lit(0))
    nodes = stored(nodes.withColumn("saved", F.when(F.col("level") > 0, (F.col("n_convs") - 1) * words).otherwise(F.lit(0))).drop("level", *W), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes, "nodes")
    owners = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.sum("saved").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owned = table.drop(*W).join(owners, F.col("conv_id").eqNullSafe(F.col("owner")), "left").fillna(0, ["total", "leaves"])
    sums = _prefixes(owned, "sum(total) AS total, sum(leaves) AS n_leaves").select(*NODE, "total", "n_leaves")
    nodes = before(nodes, "conv_id", F.expr(f"depth div {SPAN}"), [F.col("depth")], {"above": F.col("saved")})
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(sums, NODE).join(ends(table), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return nodes.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("total") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they stand."""
    return trie(plain(stored(numbered_turns(conversations), "numbered")))


def op12_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    turns = spark.read.parquet(f"{root}/conversations.parquet")
    return trie(rebuilt(stored(numbered_turns(turns), "numbered")))


# CRC-32 of the decimal id: eight steps for each byte, by the polynomial.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12_SQL = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations),
numbered AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM turns),
ids AS (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id),
crc(conv_id, rest, bit, c) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, CASE WHEN bit = 8 THEN rest[2:] ELSE rest END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
    CASE WHEN bit = 0 THEN xor(c, ascii(rest)::BIGINT) ELSE {_CRC_STEP} END
  FROM crc WHERE rest <> ''),
convs AS (
  SELECT i.conv_id, i.n, xor(c.c, 4294967295) % 4 AS h, i.conv_id - i.conv_id % 20 AS base
  FROM ids i JOIN crc c ON c.conv_id = i.conv_id AND c.rest = ''),
sized AS (
  SELECT v.*, least(v.h, coalesce(o.n, 0)) AS lead FROM convs v LEFT JOIN ids o ON o.conv_id = v.base),
rebuilt AS (
  SELECT s.conv_id, t.pos, t.digest, t.words FROM sized s JOIN numbered t ON t.conv_id = s.base AND t.pos <= s.h
  UNION ALL
  SELECT s.conv_id, t.pos - s.h + s.lead, t.digest, t.words FROM sized s JOIN numbered t ON t.conv_id = s.conv_id AND t.pos > s.h),
paths AS (
  SELECT conv_id, pos AS depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
members AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS ended, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths),
nodes AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = ended), '')) AS ends_sha256
  FROM members GROUP BY depth, path),
kids AS (SELECT above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.above = n.path),
sums AS (
  SELECT m.path, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.n_children = 0) AS n_leaves
  FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.above
"""
