"""Operator 7: chat formatting.

The turns of a conversation are collected as structs, sorted by turn, adjacent
turns of one role are merged by an array aggregation, and the whole is
concatenated with Spark expressions only.

Format of one merged turn: ``<|im_start|>role LF text <|im_end|> LF``; texts that
were merged into one turn are parted by ``<|turn|>``.  Control strings inside
texts and roles cannot be mistaken for marks: wherever ``<`` is followed by any
number of backslashes and ``|``, one more backslash is put in.  ``unescaped`` takes
it out again, so every text comes back exactly.

The loss mask is an array of spans (start, length in code points of the
formatted text), one for each text of the assistant.

Defined results: NULL text or role: empty.  NULL ``turn``: before all others; equal turns
are ordered by role and text.  NULL ``conv_id``: a conversation of its own.  Repeated rows stay.
Clashing columns are not read; empty table: empty result.  A conversation is one row, so it must fit
Spark's limit of one string (2 GB); that is a limit of the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

START, END, PART, LINE = "<|im_start|>", "<|im_end|>\n", "<|turn|>", "<|lf|>"
LOSS_ROLE = "assistant"
BLOCK = 256
# Fixed value: the extra conversation of the query's contract.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """A role stands on a line of its own, so its line feeds become a mark."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for rows (conv_id, turn, role, text)."""
    # Sorted as they are, escaped afterwards: control strings must not change the order of ties.
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("sorted"))
    marked = F.transform("sorted", lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("body")))
    chats = chats.select("conv_id", marked.alias("turns"))
    # Merge: a turn with the role of the one before joins its bodies.  Positions are kept
    # so that the arrays are only read, never copied per turn.
    firsts = F.expr("filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role != turns[i - 2].role)")
    chats = chats.withColumn("firsts", firsts)
    merged = F.expr(
        """transform(firsts, (f, k) -> struct(turns[f - 1].role as role,
             transform(slice(turns, f, coalesce(get(firsts, k + 1), size(turns) + 1) - f), t -> t.body) as bodies))"""
    )
    chats = chats.withColumn("merged", merged)
    one = F.expr(f"transform(merged, m -> concat('{START}', m.role, '\\n', array_join(m.bodies, '{PART}'), '<|im_end|>\\n'))")
    # Lengths of all pieces in order: bodies of the loss role become spans.
    heads = len(START) + 1
    pieces = F.expr(
        f"""flatten(transform(merged, m -> transform(m.bodies, (b, i) -> struct(
              cast(if(i = 0, {heads} + length(m.role), {len(PART)}) as bigint) as lead,
              cast(length(b) as bigint) as len,
              cast(if(i = size(m.bodies) - 1, {len(END)}, 0) as bigint) as tail,
              m.role = '{LOSS_ROLE}' as loss))))"""
    )
    chats = chats.withColumn("pieces", pieces)
    # Running sum of the lengths, by blocks of pieces: an aggregation that grows an array copies it
    # at every step, so it must stay short; the blocks' totals are summed the same way.
    chats = chats.withColumn("blocks", F.expr(f"transform(sequence(0, (size(pieces) - 1) div {BLOCK}), k -> slice(pieces, k * {BLOCK} + 1, {BLOCK}))"))
    within = F.expr(
        """transform(blocks, b -> aggregate(b,
             struct(cast(0 as bigint) as at, cast(array() as array<struct<start:bigint,length:bigint>>) as spans),
             (a, p) -> struct(a.at + p.lead + p.len + p.tail as at,
               if(p.loss, concat(a.spans, array(struct(a.at + p.lead as start, p.len as length))), a.spans) as spans)))"""
    )
    chats = chats.withColumn("within", within)
    starts = F.expr("aggregate(within, array(cast(0 as bigint)), (a, w) -> concat(a, array(element_at(a, -1) + w.at)))")
    chats = chats.withColumn("starts", starts)
    spans = F.expr("flatten(transform(within, (w, k) -> transform(w.spans, s -> struct(s.start + starts[k] as start, s.length as length))))")
    return chats.select("conv_id", F.array_join(one, "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text: one per original row), loss_text, formatted read back from the format."""
    blocks = F.expr(f"slice(split(formatted, '<[|]im_end[|]>\\n'), 1, size(split(formatted, '<[|]im_end[|]>\\n')) - 1)")
    cut = f"locate('\\n', b)"
    turns = F.expr(
        f"""flatten(transform(blocks, b -> transform(
              split(substring(b, {cut} + 1), '<[|]turn[|]>'),
              t -> struct(substring(b, {len(START) + 1}, {cut} - {len(START) + 1}) as role, t as text))))"""
    )
    loss = F.expr("transform(loss_spans, s -> substring(formatted, cast(s.start + 1 as int), cast(s.length as int)))")
    plain = F.transform(
        F.col("raw"), lambda t: F.struct(unescaped(F.replace(t["role"], F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(t["text"]).alias("text"))
    )
    return (
        formatted.withColumn("blocks", blocks)
        .withColumn("raw", turns)
        .select("conv_id", "formatted", plain.alias("turns"), F.array_join(F.transform(loss, unescaped), "").alias("loss_text"))
    )


def digests(parsed: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_chat_format(spark: SparkSession, root: str) -> DataFrame:
    turns = spark.read.parquet(f"{root}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    written = stored(format_chats(turns.unionByName(probe)), "chat-format")
    return digests(parse_chats(written))


_ESC = "regexp_replace(coalesce({0}, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
OP7_SQL = f"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM (SELECT unnest([0, 1]) AS i)),
marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS opens,
    {_ESC.format('role')} AS erole, {_ESC.format('text')} AS etext
  FROM rows_in WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(etext) + CASE opens WHEN 1 THEN {len(START) + 1 + len(END)} + length(erole) + {len(LINE) - 1} * (length(role) - length(replace(role, chr(10), ''))) ELSE {len(PART)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
