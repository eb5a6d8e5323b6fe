"""DuckDB statements that define the expected result of each catalogue query.

They are written independently of the Spark code: list functions instead of
column sums, rank windows instead of binned counts, sorted quantiles instead of
sketches.
"""

from __future__ import annotations

from tidepanel import schema as S
from tidepanel.operators.profile import DENSITY_CUT, DENSITY_GRID

R, V = S.RETURNS, S.VOLUMES
SIZE, K = S.FOLD_SIZE, S.FOLD_COUNT


def r(expression: str, digits: int = 6) -> str:
    """Round half up."""
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"floor(CAST({expression} AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale}"


def _list(columns: list[str]) -> str:
    return "[" + ", ".join(columns) + "]"


_ret_lags = ",\n  ".join(f"lag(ret, {i}) OVER w AS {c}" for i, c in enumerate(R))
_vol_lags = ",\n  ".join(f"CAST(lag(sv, {i}) OVER w AS DOUBLE) AS {c}" for i, c in enumerate(V) if i)

BASE = f"""
WITH li AS (
  SELECT p_brand AS ALLOCATION, CAST(l_shipdate AS DATE) AS day,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bd AS (
  SELECT ALLOCATION, day, CAST(sum(cents) AS BIGINT) AS rev, CAST(sum(units) AS BIGINT) AS sv,
    CAST(median(cents) AS DOUBLE) / CAST(100 AS DOUBLE) AS MEDIAN_DAILY_TURNOVER
  FROM li GROUP BY ALLOCATION, day),
days AS (
  SELECT day, row_number() OVER (ORDER BY day) AS date_idx, count(*) OVER () AS n_dates
  FROM (SELECT DISTINCT day FROM li)),
b1 AS (
  SELECT bd.*, date_idx, n_dates, CAST(replace(ALLOCATION, 'Brand#', '') AS BIGINT) AS brand_no,
    lag(rev) OVER w AS prev, lead(rev) OVER w AS nxt
  FROM bd JOIN days USING (day) WINDOW w AS (PARTITION BY ALLOCATION ORDER BY day)),
b2 AS (
  SELECT *, CAST(rev - prev AS DOUBLE) / CAST(nullif(rev + prev, 0) AS DOUBLE) AS ret,
    CAST(nxt - rev AS DOUBLE) / CAST(nullif(nxt + rev, 0) AS DOUBLE) AS target
  FROM b1),
panel AS (
  SELECT CAST(date_idx * 10000 + brand_no AS BIGINT) AS ROW_ID,
  'DATE_' || lpad(CAST(date_idx AS VARCHAR), 4, '0') AS TS, ALLOCATION,
  CAST(brand_no % 4 + 1 AS INTEGER) AS "GROUP", MEDIAN_DAILY_TURNOVER,
  {_ret_lags},
  CASE WHEN (date_idx * 31 + brand_no * 17) % 4 = 0 THEN CAST(sv AS DOUBLE) END AS SIGNED_VOLUME_1,
  {_vol_lags},
  target, CAST(date_idx AS INTEGER) AS date_idx, n_dates
  FROM b2 WINDOW w AS (PARTITION BY ALLOCATION ORDER BY day)),
train AS (
  SELECT *, CASE WHEN target > 0 THEN 1 ELSE 0 END AS class FROM panel WHERE date_idx <= n_dates - 120),
test AS (SELECT * FROM panel WHERE date_idx > n_dates - 120)"""

AXIS = f"""{BASE},
axis AS (
  SELECT TS, CAST(row_number() OVER (ORDER BY TS) AS INTEGER) AS date_idx, CAST(count(*) OVER () AS INTEGER) AS n_dates
  FROM (SELECT DISTINCT TS FROM train)),
placed AS (SELECT *, {K} - CAST(floor((n_dates - date_idx) / {SIZE}) AS INTEGER) AS fold,
  lag(TS) OVER (ORDER BY TS) AS previous FROM axis),
folds AS (
  SELECT CAST(fold AS INTEGER) AS fold, (SELECT min(TS) FROM axis) AS train_start, min(previous) AS train_end,
    min(TS) AS valid_start, max(TS) AS valid_end
  FROM placed WHERE fold >= 1 GROUP BY fold),
roles AS (
  SELECT t.*, f.fold, 'train' AS side FROM train t JOIN folds f ON t.TS BETWEEN f.train_start AND f.train_end
  UNION ALL BY NAME
  SELECT t.*, f.fold, 'valid' AS side FROM train t JOIN folds f ON t.TS BETWEEN f.valid_start AND f.valid_end)"""


def _mean(columns: list[str]) -> str:
    return f"list_avg({_list(columns)})"


def _std(columns: list[str]) -> str:
    return f"list_stddev_samp(list_filter({_list(columns)}, lambda x: x IS NOT NULL))"


MOMENTUM = {f"momentum_{w}": _mean(R[:w]) for w in (3, 5, 10, 20)}
MOMENTUM["delta_momentum_3_20"] = f"{_mean(R[:3])} - {_mean(R)}"
VOLATILITY = {f"volatility_{w}": _std(R[:w]) for w in (3, 20)}
VOLATILITY["delta_volatility_3_20"] = f"{_std(R[:3])} - {_std(R)}"
RATIO = {"momentum_volatility_ratio_20": f"{_mean(R)} / ({_std(R)} + 1e-4)"}
VOLUME = {f"volume_{w}": _mean(V[:w]) for w in (3, 20)}
VOLUME["delta_volume_3_20"] = f"{_mean(V[:3])} - {_mean(V)}"
ENGINEERED = MOMENTUM | VOLATILITY | RATIO | VOLUME
PERFORMANCE = {f"AVERAGE_PERF_{w}": _mean(R[:w]) for w in (3, 5, 10, 15, 20)} | {"STD_PERF_20": _std(R)}


def _select(expressions: dict[str, str], source: str = "train", keys: str = "ROW_ID", wrap: str = "{}") -> str:
    parts = ", ".join(f"{r(wrap.format(e))} AS {n}" for n, e in expressions.items())
    return f"{BASE} SELECT {keys}, {parts} FROM {source}"


# rules: the prediction of each strategy over `roles` rows
_AVG3 = _mean(R[:3])
RULES = {
    "always_0": "0",
    "always_1": "1",
    "momentum": "CASE WHEN RET_1 > 0 THEN 1 ELSE 0 END",
    "reversal": "CASE WHEN RET_1 < 0 THEN 1 ELSE 0 END",
    "agr_momentum": f"CASE WHEN {_AVG3} > 0 THEN 1 ELSE 0 END",
    "agr_reversal": f"CASE WHEN {_AVG3} < 0 THEN 1 ELSE 0 END",
    "majority": "majority_class",
}
RULE_BASE = f"""{AXIS},
rates AS (SELECT fold, avg(class) AS rate, CASE WHEN 2 * sum(class) >= count(*) THEN 1 ELSE 0 END AS majority_class
  FROM roles WHERE side = 'train' GROUP BY fold),
valid AS (SELECT * FROM roles JOIN rates USING (fold) WHERE side = 'valid')"""


def _baseline(rule: str) -> str:
    return f"""{RULE_BASE}
SELECT fold, train_start, train_end, valid_start, valid_end, {r('rate')} AS train_positive_rate,
  {r('avg(class)')} AS valid_positive_rate, {r(f'avg(CASE WHEN class = {rule} THEN 1 ELSE 0 END)')} AS accuracy,
  count(*) AS n_valid_predictions,
  CAST(sum(CASE WHEN class = {rule} THEN 1 ELSE 0 END) AS BIGINT) AS n_correct_predictions
FROM valid JOIN folds USING (fold)
GROUP BY fold, train_start, train_end, valid_start, valid_end, rate"""


STRATEGIES = f"""{RULE_BASE},
results AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS strategy, fold, avg(CASE WHEN class = {e} THEN 1 ELSE 0 END) AS accuracy FROM valid GROUP BY fold"
    for n, e in RULES.items())})"""


def _score_ctes(name: str, sign: str, rule: str) -> str:
    return f"""{name}_s AS (
  SELECT fold, class, {rule} AS prediction,
    least(greatest(CAST(0.5 AS DOUBLE) {sign} CAST(0.5 AS DOUBLE) * coalesce(RET_1, CAST(0 AS DOUBLE)), 0), 1) AS p
  FROM valid),
{name}_r AS (
  SELECT *, rank() OVER (PARTITION BY fold ORDER BY p)
    + (count(*) OVER (PARTITION BY fold, p) - 1) / CAST(2 AS DOUBLE) AS rk,
    least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q
  FROM {name}_s),
{name} AS (
  SELECT fold, avg(CASE WHEN class = prediction THEN 1 ELSE 0 END) AS accuracy,
    avg(CASE WHEN class = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS log_loss,
    (sum(CASE WHEN class = 1 THEN rk ELSE 0 END) - sum(class) * (sum(class) + 1) / CAST(2 AS DOUBLE))
      / nullif(CAST(sum(class) AS DOUBLE) * (count(*) - sum(class)), 0) AS roc_auc,
    count(*) AS n_valid_predictions,
    CAST(sum(CASE WHEN class = prediction THEN 1 ELSE 0 END) AS BIGINT) AS n_correct_predictions
  FROM {name}_r GROUP BY fold)"""


COMPARED = f"""{RULE_BASE}, {_score_ctes('mom', '+', RULES['momentum'])}, {_score_ctes('rev', '-', RULES['reversal'])},
comparison AS (
  SELECT fold, {", ".join(f"m.{x} AS {x}_momentum, v.{x} AS {x}_reversal, v.{x} - m.{x} AS delta_{x}"
                          for x in ("accuracy", "log_loss", "roc_auc"))}
  FROM mom m JOIN rev v USING (fold))"""
COMPARISON_COLUMNS = [f"{x}_{n}" for n in ("momentum", "reversal") for x in ("accuracy", "log_loss", "roc_auc")] + [
    f"delta_{x}" for x in ("accuracy", "log_loss", "roc_auc")
]


def _nulls(columns: list[str], source: str, where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nb_missing FROM {source} WHERE {where}"
        for c in columns
    )


ALL_COLUMNS = ["ROW_ID", "TS", "ALLOCATION", '"GROUP"', S.TURNOVER, *R, *V]


def _long(columns: list[str], source: str = "train", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


_RETS = ["RET_1", "RET_5", "RET_10", "RET_20"]
_VOLS = ["SIGNED_VOLUME_1", "SIGNED_VOLUME_5", "SIGNED_VOLUME_10", "SIGNED_VOLUME_20"]
PROFILED = ["target", *_RETS, *_VOLS, S.TURNOVER]
_DESCRIBED = f"""count(*) AS count, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min,
  {r('quantile_cont(value, 0.25)')} AS q25, {r('quantile_cont(value, 0.5)')} AS median,
  {r('quantile_cont(value, 0.75)')} AS q75, {r('max(value)')} AS max"""


def _boxes(long: str, by: str = "") -> str:
    key = f'{by}"column"'
    return f"""{BASE}, v AS ({long}),
q AS (SELECT {key}, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q75 FROM v GROUP BY {key}),
j AS (SELECT *, value >= q25 - 1.5 * (q75 - q25) AND value <= q75 + 1.5 * (q75 - q25) AS inside FROM v JOIN q USING ({key}))
SELECT {key}, {r('q25')} AS q25, {r('median')} AS median, {r('q75')} AS q75,
  {r('min(CASE WHEN inside THEN value END)')} AS whisker_low, {r('max(CASE WHEN inside THEN value END)')} AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM j GROUP BY {key}, q25, median, q75"""


def _density(columns: list[str], window: tuple[float, float] | None = None, bins: int | None = 1000, name: bool = False) -> str:
    """Kernel sum over grid points; over bin midpoints when ``bins`` is given."""
    g = DENSITY_GRID - 1
    start = f"CAST({window[0]} AS DOUBLE)" if window else f"lo - {DENSITY_CUT} * h"
    end = f"CAST({window[1]} AS DOUBLE)" if window else f"hi + {DENSITY_CUT} * h"
    cells = f"greatest({bins}, ceil(8 * (hi - lo) / h))"
    width = f"((hi - lo) / {cells})"
    mass = (
        'SELECT "column", value AS c, 1 AS m FROM vals'
        if bins is None
        else f"""SELECT "column", lo + (b + 0.5) * {width} AS c, m FROM (
    SELECT "column", least(floor((value - lo) / {width}), {cells} - 1) AS b, count(*) AS m
    FROM vals JOIN stats USING ("column") GROUP BY "column", b) JOIN stats USING ("column")"""
    )
    return f"""{BASE}, vals AS ({_long(columns)}),
stats AS (SELECT *, sd * pow(n, CAST(-0.2 AS DOUBLE)) AS h FROM (
  SELECT "column", count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM vals GROUP BY "column")),
mass AS ({mass}),
grid AS (SELECT "column", CAST(i AS INTEGER) AS point, {start} + i * (({end} - ({start})) / {g}) AS x
  FROM range({g + 1}) t(i), stats)
SELECT {'"column", ' if name else ''}point, {r('x')} AS x,
  {r('sum(m * exp(-0.5 * ((x - c) / h) * ((x - c) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density
FROM grid JOIN mass USING ("column") JOIN stats USING ("column") GROUP BY "column", point, x"""


def _category_diff() -> str:
    def one(c: str, label: str) -> str:
        a, b = f"SELECT DISTINCT {c} AS x FROM train", f"SELECT DISTINCT {c} AS x FROM test"
        return f"""SELECT '{label}' AS "column", (SELECT count(*) FROM ({a})) AS n_train, (SELECT count(*) FROM ({b})) AS n_test,
  (SELECT count(*) FROM ({a} EXCEPT {b})) AS only_train, (SELECT count(*) FROM ({b} EXCEPT {a})) AS only_test"""

    return f"{BASE} {one('ALLOCATION', 'ALLOCATION')} UNION ALL {one(chr(34) + 'GROUP' + chr(34), 'GROUP')}"


def _audit_report() -> str:
    """Missing cells, rows, repeated keys and key agreement of the four tables, each read once."""
    columns = ["ROW_ID", "TS", "ALLOCATION", '"GROUP"', S.TURNOVER, *R, *V]
    tables = {"train": ("train", columns), "labels": ("train", ["ROW_ID", "target"]), "test": ("test", columns), "keys": ("test", ["ROW_ID"])}
    parts = []
    for name, (source, found) in tables.items():
        names = ", ".join("'" + c.strip('"') + "'" for c in found)
        missing = ", ".join(f"CAST(count(*) - count({c}) AS DOUBLE)" for c in found)
        parts.append(f"""SELECT 'missing values' AS "check", '{name}' AS subject, unnest([{names}]) AS "column", unnest([{missing}]) AS value FROM {source}""")
        parts.append(f"""SELECT unnest(['rows', 'duplicate keys']), '{name}', 'ROW_ID',
  unnest([CAST(count(*) AS DOUBLE), CAST(count(*) - count(DISTINCT ROW_ID) AS DOUBLE)]) FROM {source}""")
    for name, a, b in (("train and labels", "train", "train"), ("test and keys", "test", "test")):
        parts.append(f"""SELECT 'aligned keys', '{name}', 'ROW_ID', CASE WHEN (SELECT count(*) FROM {a}) = (SELECT count(*) FROM {b})
  AND NOT EXISTS (SELECT ROW_ID FROM {a} EXCEPT SELECT ROW_ID FROM {b}) AND NOT EXISTS (SELECT ROW_ID FROM {b} EXCEPT SELECT ROW_ID FROM {a})
  THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END""")
    parts.append("SELECT 'same columns', 'train and test', '*', CAST(1 AS DOUBLE)")
    return f"{BASE} " + " UNION ALL ".join(parts)


def _faulty_keys(source: str, columns: str, doubled: int = 97, dropped: int = 89) -> str:
    return f"""SELECT {columns} FROM {source} WHERE ROW_ID % {dropped} <> 0
  UNION ALL SELECT {columns} FROM {source} WHERE ROW_ID % {doubled} = 0"""


def _faulty() -> dict[str, str]:
    """The checks on inputs with doubled, dropped, unknown and spoilt rows; every count is taken from the faulty tables."""
    keys = """(SELECT count(*) FROM (SELECT ROW_ID FROM b EXCEPT SELECT ROW_ID FROM a)) AS n_missing,
  (SELECT count(*) FROM (SELECT ROW_ID FROM a EXCEPT SELECT ROW_ID FROM b)) AS n_surplus"""
    overlap = f"""{AXIS}, g AS (SELECT fold, train_start, CASE WHEN fold % 2 = 0 THEN valid_end ELSE valid_start END AS train_end,
  valid_start, valid_end FROM folds),
x AS (SELECT fold, TS, TS BETWEEN train_start AND train_end AS fits, TS BETWEEN valid_start AND valid_end AS checks FROM axis, g)"""
    broken = f"""CASE WHEN ROW_ID % 83 = 0 THEN NULL WHEN ROW_ID % 71 = 0 THEN 2 ELSE {RULES['reversal']} END"""
    groups = []
    for c, label in (("ALLOCATION", "ALLOCATION"), ('"GROUP"', "GROUP")):
        a, b = f'SELECT DISTINCT {c} AS x FROM train WHERE "GROUP" <> 2', f'SELECT DISTINCT {c} AS x FROM test WHERE "GROUP" <> 3'
        groups.append(f"""SELECT '{label}' AS "column", (SELECT count(*) FROM ({a})) AS n_train, (SELECT count(*) FROM ({b})) AS n_test,
  (SELECT count(*) FROM ({a} EXCEPT {b})) AS only_train, (SELECT count(*) FROM ({b} EXCEPT {a})) AS only_test""")
    names = list(MOMENTUM) + list(VOLATILITY) + list(RATIO) + list(VOLUME)
    return {
        "dup_keys_faulty": f"""{BASE}, a AS ({_faulty_keys('train', 'ROW_ID')}) SELECT count(*) AS n_rows,
  count(DISTINCT ROW_ID) AS n_keys, count(*) - count(DISTINCT ROW_ID) AS n_duplicates FROM a""",
        "key_alignment_faulty": f"""{BASE}, a AS ({_faulty_keys('train', 'ROW_ID')}), b AS (SELECT ROW_ID FROM train WHERE ROW_ID % 79 <> 0)
SELECT count(*) AS n_found, (SELECT count(*) FROM b) AS n_expected, count(*) - count(ROW_ID) AS n_null_keys,
  count(*) - count(DISTINCT ROW_ID) AS n_repeated, {keys}, FALSE AS aligned FROM a""",
        "category_diff_faulty": f"{BASE} {' UNION ALL '.join(groups)}",
        "leak_check_faulty": f"{overlap} SELECT fold, count(*) FILTER (WHERE fits AND checks) AS n_shared FROM x GROUP BY fold",
        "fold_checks_faulty": f"""{overlap} SELECT fold, count(*) FILTER (WHERE fits) AS n_train_dates, count(*) FILTER (WHERE checks) AS n_valid_dates,
  max(CASE WHEN fits THEN TS END) AS last_train, min(CASE WHEN checks THEN TS END) AS first_valid,
  count(*) FILTER (WHERE fits AND checks) AS n_shared, count(*) FILTER (WHERE fits AND checks) = 0 AS ok FROM x GROUP BY fold""",
        "submission_checks_faulty": f"""{BASE}, good AS (SELECT ROW_ID, {RULES['reversal']} AS prediction, {broken} AS spoilt FROM test), b AS (SELECT ROW_ID FROM test),
a AS (SELECT ROW_ID, spoilt AS prediction FROM ({_faulty_keys('good', 'ROW_ID, spoilt')}) UNION ALL SELECT -ROW_ID, prediction FROM good WHERE ROW_ID % 67 = 0)
SELECT count(*) AS n_found, (SELECT count(*) FROM b) AS n_expected, count(*) - count(ROW_ID) AS n_null_keys,
  count(ROW_ID) - count(DISTINCT ROW_ID) AS n_repeated, {keys},
  count(*) AS n_rows, count(*) - count(prediction) AS n_null, count(*) FILTER (WHERE prediction NOT IN (0, 1)) AS n_not_binary,
  count(*) FILTER (WHERE prediction = 1) AS n_positive, {r('count(*) FILTER (WHERE prediction = 1) / CAST(count(prediction) AS DOUBLE)')} AS positive_rate,
  FALSE AS ok
FROM a""",
        "infinity_counts_faulty": f"""{BASE} SELECT {", ".join(
            f"count(*) FILTER (WHERE ROW_ID % {61 + 2 * k} = 0 OR isinf({ENGINEERED[n]})) AS {n}" for k, n in enumerate(names))} FROM test""",
    }


# ---- models on few inputs, fitted by the statement itself ---------------------

_X = [f"x{i}" for i in (1, 2, 3)]
_INPUTS = ", ".join(f"coalesce({c}, CAST(0 AS DOUBLE)) AS {x}" for c, x in zip(R, _X))
_CUTS = [-0.4, -0.1, 0.0, 0.1, 0.4]
_NAMED = f"CASE j {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(R[:3]))} END"
_PICKED = f"CASE j {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_X))} END"


def _fold_moments() -> str:
    columns = [*zip(R, _X), ("target", "y")]
    parts = [
        f"SELECT fold, count(*) AS n, '{a}' AS a, '{b}' AS b, {r(f'avg({p})', 8)} AS mean_a, {r(f'avg({p} * {q}) - avg({p}) * avg({q})', 8)} AS covariance FROM z GROUP BY fold"
        for i, (a, p) in enumerate(columns) for b, q in columns[i:]
    ]
    return f"{AXIS}, z AS (SELECT fold, {_INPUTS}, target AS y FROM roles WHERE side = 'train') {' UNION ALL '.join(parts)}"


def _ridge_folds() -> str:
    moment = lambda p, q, plus="": f"sum({p} * {q}) - count(*) * avg({p}) * avg({q}){plus}"
    return f"""{AXIS}, z AS (SELECT fold, {_INPUTS}, target AS y FROM roles WHERE side = 'train'),
m AS (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, {moment('x1', 'x1', ' + 1')} AS a, {moment('x1', 'x2')} AS b,
  {moment('x2', 'x2', ' + 1')} AS c, {moment('x1', 'y')} AS p, {moment('x2', 'y')} AS q FROM z GROUP BY fold),
w AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS w1, (a * q - b * p) / (a * c - b * b) AS w2 FROM m)
SELECT fold, {r('w1', 8)} AS w1, {r('w2', 8)} AS w2, {r('my - w1 * m1 - w2 * m2', 8)} AS intercept FROM w"""


def _logit_folds(steps: int = 9) -> str:
    """Newton steps written out; the penalty takes part with weight 1 on the slope."""
    chain = [
        f"""s{i} AS (
  SELECT fold, n, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
    SELECT fold, n, a, b, sum(p - y) AS g1, sum((p - y) * v) + b AS g2, sum(p * (1 - p)) AS h11, sum(p * (1 - p) * v) AS h12,
      sum(p * (1 - p) * v * v) + 1 AS h22
    FROM (SELECT z.fold, n, a, b, y, v, 1 / (1 + exp(-(a + b * v))) AS p FROM z JOIN s{i - 1} ON s{i - 1}.fold = z.fold) GROUP BY fold, n, a, b))"""
        for i in range(1, steps + 1)
    ]
    return f"""{AXIS}, raw AS (SELECT fold, coalesce(RET_1, CAST(0 AS DOUBLE)) AS x, class AS y FROM roles WHERE side = 'train'),
stats AS (SELECT fold, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s, CAST(avg(y) AS DOUBLE) AS rate FROM raw GROUP BY fold),
z AS (SELECT raw.fold, y, (x - m) / s AS v FROM raw JOIN stats ON stats.fold = raw.fold),
s0 AS (SELECT fold, n, ln(rate / (1 - rate)) AS a, CAST(0 AS DOUBLE) AS b FROM stats),
{', '.join(chain)}
SELECT fold, n, {r('a')} AS intercept, {r('b')} AS slope FROM s{steps}"""


def _stumps(model: str, label: str, start: str, g: str, h: str, score: str, fits: str, value: str, rounds: int = 3) -> tuple[str, str]:
    """(CTEs, rows) of boosted stumps: histograms at the given cut points, best cut, leaf values, new margins, round by round."""
    ctes = [f"{model}_m0 AS (SELECT ROW_ID, {_INPUTS}, CAST({label} AS DOUBLE) AS y, (SELECT {start} FROM train) AS m FROM train)"]
    for i in range(1, rounds + 1):
        ctes.append(f"""{model}_c{i} AS (
  SELECT j, k, cut, sum(CASE WHEN x <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= cut THEN h ELSE 0 END) AS hl,
    sum(CASE WHEN x <= cut THEN 1 ELSE 0 END) AS nl, sum(g) AS gt, sum(h) AS ht, count(*) AS nt
  FROM (SELECT j, k, cut, {_PICKED} AS x, {g} AS g, {h} AS h FROM {model}_m{i - 1}, cuts) GROUP BY j, k, cut)""")
        ctes.append(f"""{model}_b{i} AS (
  SELECT *, {score.format(g='gl', h='hl')} + {score.format(g='(gt - gl)', h='(ht - hl)')} - {score.format(g='gt', h='ht')} AS gain
  FROM {model}_c{i} WHERE {fits})""")
        ctes.append(f"{model}_s{i} AS (SELECT *, {value.format(g='gl', h='hl')} AS lv, {value.format(g='(gt - gl)', h='(ht - hl)')} AS rv FROM {model}_b{i} ORDER BY gain DESC, j, k LIMIT 1)")
        if i < rounds:
            ctes.append(f"{model}_m{i} AS (SELECT ROW_ID, {', '.join(_X)}, y, m + CASE WHEN {_PICKED} <= cut THEN lv ELSE rv END AS m FROM {model}_m{i - 1}, {model}_s{i})")
    rows = " UNION ALL ".join(
        f"SELECT '{model}' AS model, {i} AS round, {_NAMED} AS feature, {r('cut')} AS cut, {r('gain')} AS gain, {r('lv')} AS left_value, {r('rv')} AS right_value FROM {model}_s{i}"
        for i in range(1, rounds + 1)
    )
    return ", ".join(ctes), rows


def _boost_stumps() -> str:
    p = "(1 / (1 + exp(-m)))"
    weight = "exp(-(2 * y - 1) * m / 2)"
    wrong = "((least(gl, hl - gl) + least(gt - gl, ht - hl - gt + gl)) / ht)"
    parts = [
        _stumps("adaboost", "class", "max(CAST(0 AS DOUBLE))", f"{weight} * y", weight, "(({g} * {g} + ({h} - {g}) * ({h} - {g})) / {h})", "nl >= 1 AND nt - nl >= 1",
                f"(CASE WHEN {{g}} > {{h}} - {{g}} THEN 0.1 ELSE -0.1 END * ln((1 - {wrong}) / {wrong}))"),
        _stumps("level_wise", "class", "ln(avg(class) / (1 - avg(class)))", f"({p} - y)", f"({p} * (1 - {p}))", "({g} * {g} / ({h} + 1))",
                "nl >= 1 AND nt - nl >= 1 AND hl >= 1 AND ht - hl >= 1", "(-0.05 * {g} / ({h} + 1))"),
        _stumps("regression", "target", "avg(target)", "(m - y)", "CAST(1 AS DOUBLE)", "({g} * {g} / {h})", "nl >= 20 AND nt - nl >= 20", "(-0.01 * {g} / {h})"),
    ]
    cuts = " UNION ALL ".join(f"SELECT {j} AS j, {k} AS k, CAST({c} AS DOUBLE) AS cut" for j in range(3) for k, c in enumerate(_CUTS))
    return f"{BASE}, cuts AS ({cuts}), {', '.join(c for c, _ in parts)} {' UNION ALL '.join(rows for _, rows in parts)}"


def oracle_sql() -> dict[str, str]:
    panel = ["ROW_ID", "TS", "ALLOCATION", '"GROUP"', "date_idx", "n_dates"]
    doubles = [S.TURNOVER, *R, *V, "target"]
    cross = ", ".join(f"{r(n)} AS {n}, {r(f'avg({n}) OVER (PARTITION BY TS)')} AS ALLOCATIONS_{n}" for n in PERFORMANCE)
    made = ", ".join(f"{e} AS {n}" for n, e in PERFORMANCE.items())
    kfold = f"{AXIS}, kf AS (SELECT TS, CAST((date_idx - 1) % 8 AS INTEGER) AS fold FROM axis)"
    binary = f"SELECT ROW_ID, {RULES['reversal']} AS prediction FROM test"
    sql = {
        "panel": f"{BASE} SELECT {', '.join(panel)}, {', '.join(doubles)} FROM panel",
        "submission_order": f"{BASE} SELECT count(*) AS n_found, count(*) AS n_expected, CAST(0 AS BIGINT) AS n_out_of_place, TRUE AS same_order FROM test",
        "submission_order_faulty": f"{BASE} SELECT count(*) AS n_found, count(*) AS n_expected, CAST(2 AS BIGINT) AS n_out_of_place, FALSE AS same_order FROM test",
        "fold_moments": _fold_moments(),
        "ridge_folds": _ridge_folds(),
        "logit_folds": _logit_folds(),
        "boost_stumps": _boost_stumps(),
        "label_join": f"{BASE} SELECT ROW_ID, TS, ALLOCATION, RET_1, target, class FROM train",
        "feat_momentum": _select(MOMENTUM),
        "feat_volatility": _select(VOLATILITY),
        "feat_ratio": _select(RATIO),
        "feat_volume": _select(VOLUME),
        "feat_all": _select(ENGINEERED),
        "feat_filled": _select(ENGINEERED, wrap="coalesce({}, 0)"),
        "feat_performance": _select(PERFORMANCE),
        "feat_cross_section": f"{BASE}, p AS (SELECT ROW_ID, TS, {made} FROM train) SELECT ROW_ID, {cross} FROM p",
        "feat_test": _select(ENGINEERED, "test", "ROW_ID, TS"),
        "date_axis": f"{AXIS} SELECT TS, date_idx, n_dates FROM axis",
        "axis_bounds": f"{BASE} SELECT min(TS) AS first_date, max(TS) AS last_date FROM train",
        "axis_continuity": f"""{BASE} SELECT count(DISTINCT TS) AS n_dates, min(CAST(substr(TS, 6) AS INTEGER)) AS first_no,
  max(CAST(substr(TS, 6) AS INTEGER)) AS last_no,
  count(DISTINCT TS) = max(CAST(substr(TS, 6) AS INTEGER)) - min(CAST(substr(TS, 6) AS INTEGER)) + 1 AS continuous FROM train""",
        "folds": f"{AXIS} SELECT fold, train_start, train_end, valid_start, valid_end FROM folds",
        "fold_stats": f"""{AXIS} SELECT fold, side, count(DISTINCT TS) AS n_dates, count(*) AS n_rows,
  {r('avg(class) * 100')} AS pct_class_1 FROM roles GROUP BY fold, side""",
        "fold_checks": f"""{AXIS}, d AS (SELECT DISTINCT fold, side, TS FROM roles)
SELECT fold, count(*) FILTER (WHERE side = 'train') AS n_train_dates, count(*) FILTER (WHERE side = 'valid') AS n_valid_dates,
  max(CASE WHEN side = 'train' THEN TS END) AS last_train, min(CASE WHEN side = 'valid' THEN TS END) AS first_valid,
  count(*) - count(DISTINCT TS) AS n_shared,
  max(CASE WHEN side = 'train' THEN TS END) < min(CASE WHEN side = 'valid' THEN TS END)
    AND count(*) FILTER (WHERE side = 'valid') = {SIZE} AS ok
FROM d GROUP BY fold""",
        "fold_assignment": f"{AXIS} SELECT ROW_ID, TS, fold, side FROM roles",
        "holdout_last120": f"""{AXIS}, s AS (SELECT t.*, CASE WHEN a.date_idx > a.n_dates - {SIZE} THEN 'valid' ELSE 'train' END AS side
  FROM train t JOIN axis a USING (TS))
SELECT side, count(DISTINCT TS) AS n_side_dates, min(TS) AS first_date, max(TS) AS last_date, count(*) AS n_rows,
  {r('avg(class) * 100')} AS pct_class_1 FROM s GROUP BY side""",
        "holdout_rows": f"""{AXIS} SELECT ROW_ID, CASE WHEN a.date_idx > a.n_dates - {SIZE} THEN 'valid' ELSE 'train' END AS side
  FROM train t JOIN axis a USING (TS)""",
        "leak_check": f"""{AXIS} SELECT fold, (SELECT count(*) FROM (
  SELECT TS FROM roles x WHERE x.fold = f.fold AND side = 'train'
  INTERSECT SELECT TS FROM roles x WHERE x.fold = f.fold AND side = 'valid')) AS n_shared FROM folds f""",
        "tuning_split": f"""{AXIS} SELECT ROW_ID, TS FROM train WHERE TS <= (SELECT valid_end FROM folds WHERE fold = {K - 1})""",
        "date_kfold": f"{kfold} SELECT TS, fold FROM kf",
        "date_kfold_shuffled": f"""{AXIS} SELECT TS, CAST((row_number() OVER (ORDER BY md5(TS || ':0'), TS) - 1) % 8 AS INTEGER) AS fold FROM axis""",
        "audit_report": _audit_report(),
        "baseline_table": f"""{STRATEGIES} SELECT fold, {", ".join(
            r(f"max(CASE WHEN strategy = '{n}' THEN accuracy END)") + f" AS {n}" for n in RULES)}
FROM results GROUP BY fold""",
        "baseline_summary": f"""{STRATEGIES} SELECT strategy, {r('avg(accuracy)')} AS mean_accuracy,
  {r('stddev_samp(accuracy)')} AS std_accuracy, {r('min(accuracy)')} AS min_accuracy, {r('max(accuracy)')} AS max_accuracy
FROM results GROUP BY strategy""",
        "metrics_rule_scores": f"""{RULE_BASE}, {_score_ctes('rev', '-', RULES['reversal'])}
SELECT fold, {r('accuracy')} AS accuracy, {r('log_loss')} AS log_loss, {r('roc_auc')} AS roc_auc,
  n_valid_predictions, n_correct_predictions FROM rev""",
        "compare_rules": f"{COMPARED} SELECT fold, {', '.join(f'{r(c)} AS {c}' for c in COMPARISON_COLUMNS)} FROM comparison",
        "folds_beating": f"{COMPARED} SELECT count(*) FILTER (WHERE delta_accuracy > 0) AS folds_ahead, count(*) AS n_folds FROM comparison",
        "comparison_means": f"{COMPARED} SELECT {', '.join(r(f'avg({c})') + f' AS {c}' for c in COMPARISON_COLUMNS)} FROM comparison",
        "cv_band": f"""{STRATEGIES}, b AS (SELECT avg(accuracy) * 100 AS m, stddev_pop(accuracy) * 100 AS s
  FROM results WHERE strategy = 'reversal')
SELECT {r('m')} AS mean_pct, {r('s')} AS std_pct, {r('m - s')} AS lower_pct, {r('m + s')} AS upper_pct FROM b""",
        "sign_accuracy": f"""{kfold} SELECT fold,
  {r('avg(CASE WHEN (coalesce(target, 0) > 0) = (coalesce(-RET_1, 0) > 0) THEN 1 ELSE 0 END)')} AS accuracy, count(*) AS n
FROM train JOIN kf USING (TS) GROUP BY fold""",
        "null_audit": f"""{BASE} SELECT "column", nb_missing, {r('nb_missing * 100.0 / n')} AS pct_missing
FROM ({_nulls([S.TURNOVER, *R, *V], 'train')})""",
        "null_columns": f"""{BASE} SELECT replace("column", '"', '') AS "column", nb_missing
FROM ({_nulls(ALL_COLUMNS, 'test')}) WHERE nb_missing >= 1""",
        "null_by_class": f"""{BASE} {" UNION ALL ".join(
            f'''SELECT {k} AS class, "column", nb_missing, {r('nb_missing * 100.0 / n')} AS pct_missing
FROM ({_nulls([S.TURNOVER, *V], 'train', w)})'''
            for k, w in (("CAST(NULL AS INTEGER)", "TRUE"), ("0", "class = 0"), ("1", "class = 1")))}""",
        "null_total": f"{BASE} SELECT CAST(sum(nb_missing) AS BIGINT) AS nb_missing FROM ({_nulls(ALL_COLUMNS, 'test')})",
        "dup_keys": f"""{BASE} SELECT count(*) AS n_rows, count(DISTINCT ROW_ID) AS n_keys,
  count(*) - count(DISTINCT ROW_ID) AS n_duplicates FROM train""",
        "key_alignment": f"""{BASE} SELECT count(*) AS n_found, count(*) AS n_expected,
  count(*) - count(ROW_ID) AS n_null_keys, count(*) - count(DISTINCT ROW_ID) AS n_repeated,
  CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_surplus, TRUE AS aligned FROM train""",
        "distinct_counts": f"""{BASE} SELECT 'TS' AS "column", count(DISTINCT TS) AS n_distinct FROM train
UNION ALL SELECT 'ALLOCATION', count(DISTINCT ALLOCATION) FROM train
UNION ALL SELECT 'GROUP', count(DISTINCT "GROUP") FROM train""",
        "distinct_dates": f"{BASE} SELECT DISTINCT TS FROM test",
        "group_counts": f'{BASE} SELECT "GROUP", count(*) AS n FROM train GROUP BY "GROUP"',
        "top_allocations": f"{BASE} SELECT ALLOCATION, count(*) AS n FROM train GROUP BY ALLOCATION ORDER BY n DESC, ALLOCATION LIMIT 10",
        "top_positive_allocations": f"""{BASE} SELECT ALLOCATION, CAST(sum(class) AS BIGINT) AS class_1,
  CAST(sum(1 - class) AS BIGINT) AS class_0, {r('sum(class) * 100.0 / count(*)')} AS pct_of_class_1
FROM train GROUP BY ALLOCATION ORDER BY class_1 DESC, ALLOCATION LIMIT 10""",
        "allocation_classes": f"""{BASE} SELECT ALLOCATION, CAST(sum(class) AS BIGINT) AS class_1,
  CAST(sum(1 - class) AS BIGINT) AS class_0, {r('sum(class) * 100.0 / count(*)')} AS pct_of_class_1
FROM train GROUP BY ALLOCATION""",
        "category_diff": _category_diff(),
        "class_share": f"""{BASE} SELECT class, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(*) FROM train)')} AS pct
FROM train GROUP BY class""",
        "rows_per_date": f"{BASE} SELECT TS, count(*) AS n_rows FROM train GROUP BY TS",
        "date_profile": f"""{BASE}, v AS (SELECT CAST(count(*) AS DOUBLE) AS value FROM train GROUP BY TS)
SELECT 'n_rows' AS "column", {_DESCRIBED} FROM v""",
        "positive_rate_by_date": f"{BASE} SELECT TS, {r('avg(class)')} AS positive_rate FROM train GROUP BY TS",
        "positive_rate_profile": f"""{BASE}, v AS (SELECT avg(class) AS value FROM train GROUP BY TS)
SELECT 'positive_rate' AS "column", {_DESCRIBED} FROM v""",
        "ret_mean_by_class": f"""{BASE} {" UNION ALL ".join(
            f'''SELECT '{c}' AS ret, {r(f'avg({c}) FILTER (WHERE class = 0)')} AS mean_0,
{r(f'avg({c}) FILTER (WHERE class = 1)')} AS mean_1,
{r(f'avg({c}) FILTER (WHERE class = 1) - avg({c}) FILTER (WHERE class = 0)')} AS diff_mean FROM train''' for c in R)}""",
        "preview": f"{BASE} SELECT ROW_ID, TS, ALLOCATION, {r('target')} AS target, class FROM train ORDER BY ROW_ID LIMIT 5",
        "describe": f"""{BASE}, v AS ({_long(PROFILED)}) SELECT "column", {_DESCRIBED} FROM v GROUP BY "column" """,
        "centre_lines": f"""{BASE}, v AS ({_long(PROFILED)})
SELECT "column", {r('avg(value)')} AS mean, {r('median(value)')} AS median FROM v GROUP BY "column" """,
        "box_stats": _boxes(_long(PROFILED)),
        "box_stats_by_class": _boxes(_long([S.TURNOVER, "RET_1"], extra="class, "), "class, "),
        "histogram_target": f"""{BASE}, s AS (SELECT min(target) AS lo, (max(target) - min(target)) / 100 AS w FROM train),
c AS (SELECT least(floor((target - lo) / w), 99) AS b, count(*) AS n FROM train, s WHERE target IS NOT NULL GROUP BY b)
SELECT CAST(i AS INTEGER) AS bin, {r('lo + i * w')} AS bin_start, {r('lo + (i + 1) * w')} AS bin_end, coalesce(n, 0) AS n
FROM range(100) t(i) CROSS JOIN s LEFT JOIN c ON b = i""",
        "density_target": _density(["target"]),
        "density_zoom": _density(["target"], (-0.01, 0.01)),
        "density_exact": _density(["RET_1"], bins=None),
        "density_profiled": _density(PROFILED, name=True),
        "submission": f"{BASE} {binary}",
        "submission_checks": f"""{BASE}, s AS ({binary})
SELECT count(*) AS n_found, (SELECT count(*) FROM test) AS n_expected, count(*) - count(ROW_ID) AS n_null_keys,
  count(ROW_ID) - count(DISTINCT ROW_ID) AS n_repeated,
  (SELECT count(*) FROM (SELECT ROW_ID FROM test EXCEPT SELECT ROW_ID FROM s)) AS n_missing,
  (SELECT count(*) FROM (SELECT ROW_ID FROM s EXCEPT SELECT ROW_ID FROM test)) AS n_surplus,
  count(*) AS n_rows, count(*) - count(prediction) AS n_null, count(*) FILTER (WHERE prediction NOT IN (0, 1)) AS n_not_binary,
  count(*) FILTER (WHERE prediction = 1) AS n_positive, {r('avg(prediction)')} AS positive_rate,
  count(*) = count(DISTINCT ROW_ID) AND count(*) = (SELECT count(*) FROM test) AS ok
FROM s""",
        "run_report": f"""{BASE}, s AS (SELECT {RULES['agr_reversal']} AS prediction FROM test)
SELECT count(*) AS n_rows, count(*) - count(prediction) AS n_null, count(*) FILTER (WHERE prediction NOT IN (0, 1)) AS n_not_binary,
  count(*) FILTER (WHERE prediction = 1) AS n_positive, {r('avg(prediction)')} AS positive_rate FROM s""",
        "infinity_counts": f"""{BASE} SELECT {", ".join(
            f"count(*) FILTER (WHERE isinf({e})) AS {n}" for n, e in ENGINEERED.items())} FROM test""",
    }
    sql |= _faulty() | {
        "csv_train": f"""{BASE} SELECT ROW_ID, TS, ALLOCATION, "GROUP", {S.TURNOVER}, RET_1, RET_20, SIGNED_VOLUME_1, SIGNED_VOLUME_20, target, class FROM train""",
        "csv_test": f"{BASE} SELECT ROW_ID, TS, ALLOCATION, RET_1, RET_20 FROM test",
        "csv_predictions": f"{BASE} SELECT ROW_ID, {RULES['reversal']} AS prediction, {RULES['momentum']} AS sign FROM test",
    }
    for name, rule in RULES.items():
        sql[f"baseline_{name}"] = _baseline(rule)
    return sql
