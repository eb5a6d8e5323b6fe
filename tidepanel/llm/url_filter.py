"""Operator 5: URL filters.

Every rule is a regular expression with the literal tokens that a matching URL
must hold.  A rule is indexed by the one of its tokens that is rarest in the
URLs at hand; the tokens of a URL fetch candidate rules, and only those run
their expression.  DataFrame operations only.

Two kinds of rules share the index.  *Site rules* (``example.net/en/``) fit
their host and all its subdomains when the path starts with theirs; the longest
that fits decides.  *Pattern rules* decide the URLs that no site rule fits: one
hit blocks, none allows.

Defined results: NULL URL or one without ``://``: host and path are empty, no
site or pattern rule fits, verdict ``allow``.  Repeated rows stay, each with its
own verdict.  Clashing column names of the input are not read.  An empty table gives an
empty result; an empty rule table allows everything.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import ascii_lower

# The site rules of the query's contract.
SITE_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
# Own pattern rules: tokens that every match holds as whole tokens, and an expression over host + path as they are.
PATTERN_RULES = (
    ("spam-farm", ("spam", "farm"), r"^([^/]*\.)?spam-farm\."),
    ("cheap-pills", ("cheap", "pills"), r"^([^/]*\.)?cheap-pills\."),
    ("casino", ("casino",), r"(^|[./-])casino([./-]|$)"),
    ("free-download", ("free",), r"/free-download(s)?(/|$)"),
    ("adult", ("xxx",), r"(^|[./-])xxx([./-]|$)"),
)
# A token is a run of ASCII letters, digits and anything beyond ASCII; rules without one share the token "", which every URL has.
_WITHIN = "0-9a-z\u0080-\U0010ffff"
TOKEN = f"[{_WITHIN}]+"
ANY_URL = ""
RULE_SCHEMA = "rule string, kind string, verdict string, tokens array<string>, pattern string"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(rule: str, verdict: str) -> tuple:
    """The row of a site rule: host labels and path words are its literal tokens."""
    host, slash, path = rule.partition("/")
    # The last path word may be the start of a longer one, so it is no token unless the rule ends it.
    literal = re.findall(TOKEN, host) + re.findall(f"{TOKEN}(?=[^A-Z{_WITHIN}])", path if path.islower() else "")
    return rule, "site", verdict, literal, r"^([^/]*\.)?" + re.escape(host) + re.escape(slash + path)


def _edges(items: list) -> tuple[bool, bool, list[str]]:
    """(a match begins at, ends at a token's edge; tokens that every match holds whole) of a parsed expression.

    Cautious: what is not understood has no edge and no tokens.
    """
    found, run, open_left, first, edge = [], "", False, None, False
    for kind, value in [*items, (None, None)]:
        kind = str(kind)
        if kind == "LITERAL" and re.fullmatch(TOKEN, chr(value)):
            if not run:
                open_left = not edge
            run, edge = run + chr(value), False
            first = False if first is None else first
            continue
        if kind == "LITERAL":
            begins = ends = not chr(value).isalnum()
            inner = []
        elif kind == "AT":
            begins = ends = True
            inner = []
        elif kind == "IN":
            begins = ends = all(str(k) == "LITERAL" and ord(" ") < v < 128 and not chr(v).isalnum() for k, v in value)
            inner = []
        elif kind == "SUBPATTERN":
            begins, ends, inner = _edges(list(value[3]))
        elif kind == "BRANCH":
            parts = [_edges(list(branch)) for branch in value[1]]
            begins, ends = all(p[0] for p in parts), all(p[1] for p in parts)
            inner = [t for t in parts[0][2] if all(t in p[2] for p in parts)]
        elif kind == "MAX_REPEAT" and value[0] == 0:
            # Left out, it hands on the edge before it.
            begins, ends, inner = False, _edges(list(value[2]))[1] and edge and not run, []
        else:
            begins = ends = False
            inner = []
        if run:
            if begins and not open_left:
                found.append(run)
            run = ""
        if kind != "None":
            found += inner
            first = begins if first is None else first
            edge = ends
    return bool(first), edge, found


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every match of the expression holds as whole tokens, read off its parsed form; none if case is ignored."""
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    return list(dict.fromkeys(_edges(list(parsed))[2]))


def rule_table(spark: SparkSession, sites: Sequence[tuple] = SITE_RULES, patterns: Sequence[tuple] = PATTERN_RULES) -> DataFrame:
    rows = [site_rule(*r) for r in sites] + [(n, "pattern", "block", literal_tokens(p) if t is None else list(t), p) for n, t, p in patterns]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def filter_urls(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``id_column``, host, path, rule, verdict and ``pattern_rule`` (first pattern rule that hit) per row of ``urls``.

    The URL table is reduced to its distinct host and path before anything is
    joined, so that repeated URLs and hot hosts cost one judgement each.  The
    rule index is joined by token; Catalyst broadcasts it only below its size
    threshold and splits hot tokens otherwise.
    """
    pages = urls.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    keys = pages.select("host", "path").distinct()
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit(TOKEN), 0))
    tokens = keys.select("host", "path", F.explode(F.array_append(words, F.lit(ANY_URL))).alias("token"))
    literal = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(ANY_URL)))
    wanted = rules.select("rule", F.explode(literal).alias("token")).distinct()
    counts = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    # Rarest literal token of each rule; tokens that no URL holds count zero.
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token"))).alias("rare"))
        .select("rule", F.col("rare.token").alias("token"))
    )
    index = rules.select("rule", "kind", F.col("verdict").alias("rule_verdict"), "pattern").join(rarest, "rule")
    hits = (
        tokens.join(index, "token")
        .where(F.expr("rlike(concat(host, path), pattern)"))
        .groupBy("host", "path")
        .agg(
            F.max(F.when(F.col("kind") == "site", F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))).alias("site"),
            F.min(F.when(F.col("kind") == "pattern", F.col("rule"))).alias("pattern_rule"),
        )
    )
    verdict = F.coalesce(F.col("site.rule_verdict"), F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow"))
    return pages.join(hits, ["host", "path"], "left").select(
        id_column, "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), "pattern_rule"
    )


def op5_url_filters(spark: SparkSession, root: str) -> DataFrame:
    pages = spark.read.parquet(f"{root}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_table(spark))


_SITE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for r, _ in sorted(SITE_RULES, key=lambda x: -len(x[0]))
) + " END"
_PATTERN_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(host || path, '{p}') THEN '{n}'" for n, _, p in sorted(PATTERN_RULES)
) + " END"

OP5_SQL = f"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, {_SITE_SQL} AS rule, {_PATTERN_SQL} AS pattern_rule FROM cut)
SELECT page_id, host, path, rule,
  CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in SITE_RULES)} WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  pattern_rule
FROM ruled
"""
