"""SQL for each query, written for a plain SQL engine over the same tables.

Where it can be, the SQL takes another road than the query: long joins instead of arrays, ranks instead
of counts, brute force instead of grids, recursion instead of closed forms.
"""

from __future__ import annotations

SLOTS = range(1, 8)
ORACLES: dict[str, str] = {}


def _join(parts, sep=", "):
    return sep.join(parts)


# --- fixtures as SQL -----------------------------------------------------------------------------

_LINE_COLS = _join(
    [f"sum(l_quantity) FILTER (WHERE l_linenumber = {i}) AS rate{i}" for i in SLOTS]
    + [f"min(l_returnflag) FILTER (WHERE l_linenumber = {i}) AS prod{i}" for i in SLOTS]
    + [f"min(l_shipdate) FILTER (WHERE l_linenumber = {i}) AS ship{i}" for i in SLOTS])


def _date_case(i: int) -> str:
    kind = f"(o_orderkey + {i}) % 7"
    us = f"concat(month(ship{i}), '/', day(ship{i}), '/', year(ship{i}))"
    return (f"CASE WHEN ship{i} IS NULL THEN NULL WHEN {kind} = 1 THEN CAST(year(ship{i}) AS VARCHAR) "
            f"WHEN {kind} = 2 THEN 'fall' WHEN {kind} = 3 THEN '' WHEN {kind} = 4 THEN {us} "
            f"ELSE strftime(ship{i}, '%Y-%m-%d') END")


ORDERS_WIDE = f"""
lines_wide AS (SELECT l_orderkey, count(*) AS n, {_LINE_COLS} FROM lineitem GROUP BY l_orderkey),
wide AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate,
  coalesce(n, 0) AS n_lines, {_join(f'rate{i}' for i in SLOTS)}, {_join(f'prod{i}' for i in SLOTS)},
  {_join(f'ship{i}' for i in SLOTS)}, {_join(f'{_date_case(i)} AS date{i}' for i in SLOTS)}
  FROM orders LEFT JOIN lines_wide ON o_orderkey = l_orderkey)"""


def _weekly(weeks) -> str:
    cols = _join([f"sum(l_quantity) FILTER (WHERE week = {w}) AS wk{w}a" for w in weeks]
                 + [f"sum(l_extendedprice) FILTER (WHERE week = {w}) AS wk{w}b" for w in weeks])
    return f"""
dated AS (SELECT o_custkey AS unit, year(l_shipdate) AS year, l_quantity, l_extendedprice,
  (dayofyear(l_shipdate) - 1) // 7 AS week FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
anchors AS (SELECT o_custkey AS unit, year(o_orderdate) AS year, min(dayofyear(o_orderdate)) AS day
  FROM orders GROUP BY ALL),
weekly AS (SELECT unit, year, {cols} FROM dated GROUP BY unit, year),
units AS (SELECT weekly.*, anchors.day FROM weekly LEFT JOIN anchors USING (unit, year))"""


PREDS = """preds AS (SELECT l_suppkey AS unit, l_linenumber AS fold, l_returnflag, l_linestatus, l_extendedprice AS y,
  l_quantity * 1000 AS pred FROM lineitem)"""

ERRORS = PREDS + """, errors AS (SELECT *, abs(y - pred) AS err, CASE WHEN y <> 0 THEN abs(y - pred) / y * 100 END AS pct
  FROM preds)"""

LEARN = """learn AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SHAPES = """shp AS (SELECT s_suppkey AS id, s_acctbal, s_suppkey % 5 AS kind, (s_suppkey * 37) % 401 - 200 AS x,
  (s_suppkey * 53) % 401 - 200 AS y, 8 + s_suppkey % 40 AS w, 8 + (s_suppkey * 7) % 60 AS h,
  (8 + s_suppkey % 40) // 4 AS qw, (8 + (s_suppkey * 7) % 60) // 4 AS qh FROM supplier),
corners AS (
  SELECT id, 0 AS ring, unnest([[x, y], [x + w, y], [x + w, y + h], [x, y + h]]) AS c, generate_subscripts([1,1,1,1], 1) AS i
    FROM shp WHERE kind <= 2
  UNION ALL SELECT id, 0, unnest([[x, y], [x + w, y], [x, y + h]]), generate_subscripts([1,1,1], 1) FROM shp WHERE kind > 2
  UNION ALL SELECT id, 1, unnest([[x + qw, y + qh], [x + 2 * qw, y + qh], [x + 2 * qw, y + 2 * qh], [x + qw, y + 2 * qh]]),
    generate_subscripts([1,1,1,1], 1) FROM shp WHERE kind = 0),
sides AS (SELECT id, ring, c[1] / 1000.0::DOUBLE AS x1, c[2] / 1000.0::DOUBLE AS y1,
  coalesce(lead(c) OVER w, first_value(c) OVER w)[1] / 1000.0::DOUBLE AS x2,
  coalesce(lead(c) OVER w, first_value(c) OVER w)[2] / 1000.0::DOUBLE AS y2
  FROM corners WINDOW w AS (PARTITION BY id, ring ORDER BY i)),
pts AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings),
crossings AS (SELECT id, vec_id, count(*) FILTER (WHERE (y1 > py) <> (y2 > py)
  AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) AS n FROM sides CROSS JOIN pts GROUP BY id, vec_id),
held AS (SELECT DISTINCT id FROM crossings WHERE n % 2 = 1)"""


def r(expr: str, places: int = 4) -> str:
    return f"round(({expr})::DOUBLE, {places}) + 0.0"


# --- columns -------------------------------------------------------------------------------------

ORACLES["column_select"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, n_lines, o_orderpriority,
  {_join(f'prod{i}' for i in range(1, 7))} FROM wide"""

_ALL = range(10, 44)
ORACLES["clean"] = f"""WITH {_weekly(_ALL)} SELECT unit, year::INT AS "YearID", day::INT AS day,
  {_join(f'{r(f"wk{w}a", 2)} AS wk{w}a' for w in range(14, 40))},
  {_join(f'{r(f"wk{w}b", 2)} AS "WK{w}b"' for w in range(14, 40))} FROM units"""

ORACLES["sanitize"] = "SELECT c_custkey, c_acctbal AS acct__bal, c_mktsegment AS mkt__segment FROM customer"

ORACLES["align_features"] = f"""WITH {ORDERS_WIDE}
SELECT o_orderkey, rate1, 0.0::DOUBLE AS extra_feature, rate2 FROM wide"""

ORACLES["enforce_kinds"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  try_cast(nullif(date1, '') AS DOUBLE) AS date1, CAST(n_lines AS VARCHAR) AS n_lines, o_orderpriority FROM wide"""

# --- filters -------------------------------------------------------------------------------------

ORACLES["base_filter"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, o_orderstatus, rate1, rate2, prod3 FROM wide
WHERE o_orderstatus IN ('F', 'O') AND rate1 IS NOT NULL AND prod3 IS NOT NULL AND rate2 > 0"""

ORACLES["time_split"] = """SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'test' END AS side FROM orders"""

ORACLES["holdout_split"] = """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') THEN 'holdout' ELSE 'train' END AS side FROM orders"""

_OUT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLES["outliers"] = f"""WITH capped AS (SELECT * FROM lineitem WHERE l_extendedprice <= 80000),
q AS (SELECT {_join(f'quantile_cont({c}, 0.002) AS lo_{c}, quantile_cont({c}, 0.998) AS hi_{c}' for c in _OUT)} FROM capped)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_join(_OUT)} FROM capped, q
WHERE {_join([f'{c} BETWEEN lo_{c} AND hi_{c}' for c in _OUT], ' AND ')}"""

ORACLES["winsorize"] = f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, {r('CASE WHEN o_totalprice > m + 1.2 * sd THEN m + 1.2 * sd WHEN o_totalprice < greatest(0, m - 1.2 * sd) THEN greatest(0, m - 1.2 * sd) ELSE o_totalprice END', 3)} AS o_totalprice
FROM orders, s"""

ORACLES["fill_mean"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey,
  {_join(f'{r(f"coalesce(rate{i}, avg(rate{i}) OVER ())", 6)} AS rate{i}' for i in range(1, 5))} FROM wide"""

ORACLES["sample_rows"] = """SELECT least(100, count(*)) AS n_rows, least(100, count(*)) AS n_distinct,
  least(100, count(*)) AS n_found FROM orders"""

ORACLES["sample_fraction"] = "SELECT count(*) AS orders, 1::BIGINT AS max_sides FROM orders"

# --- flags, slots, labels ------------------------------------------------------------------------

ORACLES["exists_flags"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, prod1 IS NOT NULL AS prod1_exists,
  prod6 IS NOT NULL AND prod7 IS NOT NULL AS "Tail_exists", prod2 IS NOT NULL AS "Mixed_exists" FROM wide"""

ORACLES["slot_totals"] = """WITH per_line AS (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
per_order AS (SELECT l_orderkey, sum(q) AS total, count(*) AS lines,
  sum(CASE WHEN l_linenumber >= 6 THEN q ELSE 0 END) AS tail, count(*) FILTER (WHERE l_linenumber >= 6) AS tail_lines,
  sum(CASE WHEN l_linenumber = 5 THEN q ELSE 0 END) AS five FROM per_line GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(total, 0.0) AS "Line_TotalRate",
  CAST(coalesce(lines, 0) AS INT) AS "Line_Count", coalesce(tail, 0.0) AS "Tail_TotalRate",
  CAST(coalesce(tail_lines, 0) AS INT) AS "Tail_Count", coalesce(five, 0.0) AS "RateOnly_TotalRate"
FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey"""


def _biweek(c: str) -> str:
    day = f"dayofyear(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y')))"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = '' THEN '' WHEN regexp_full_match({c}, '\\s*\\d+\\s*') "
            f"THEN concat('_', {c}, '_') WHEN {day} IS NOT NULL THEN CAST(({day} + 13) // 14 AS VARCHAR) "
            f"ELSE concat('_', {c}, '_') END")


ORACLES["biweek"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey,
  {_join(f'{_biweek(f"date{i}")} AS date{i}_biweek' for i in SLOTS)} FROM wide"""

ORACLES["normalize_labels"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey,
  CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN lower(o_orderpriority) END AS mixed, lower(prod1) AS prod1 FROM wide"""

ORACLES["prev_delta"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, rate1, rate2,
  CASE WHEN rate2 > rate1 THEN rate2 - rate1 END AS "Up", rate4 - rate3 AS "Any" FROM wide"""

# --- ordered -------------------------------------------------------------------------------------


def _window_sql(n: int, prefix: str = "Wk") -> str:
    """CTE ``aligned`` in long form, then ``pivoted`` with one column per offset."""
    cols = []
    for m in ("A", "B"):
        cols += [f"{r(f'max(v) FILTER (WHERE m = {m!r} AND i = {i})', 2)} AS {prefix}{i:02d}{m}" for i in range(n)]
        cols += [f"{r(f'max(total) FILTER (WHERE m = {m!r} AND i = {i})', 2)} AS {prefix}{i:02d}Total{m}" for i in range(1, n)]
    return f"""
amounts AS (SELECT unit, year, week, 'A' AS m, sum(l_quantity) AS v FROM dated GROUP BY ALL
  UNION ALL SELECT unit, year, week, 'B', sum(l_extendedprice) FROM dated GROUP BY ALL),
offsets AS (SELECT u.unit, u.year, m, i,
  greatest(14, least(39, CAST(round_even(u.day / 7.0, 0) AS INT) + i)) AS week
  FROM units u, (SELECT unnest(['A', 'B']) AS m), (SELECT unnest(range({n})) AS i) WHERE u.day IS NOT NULL),
valued AS (SELECT o.unit, o.year, o.m, o.i, coalesce(a.v, 0.0) AS v
  FROM offsets o LEFT JOIN amounts a ON o.unit = a.unit AND o.year = a.year AND o.m = a.m AND o.week = a.week),
aligned AS (SELECT *, sum(v) OVER (PARTITION BY unit, year, m ORDER BY i) AS total FROM valued),
pivoted AS (SELECT unit, year, {_join(cols)} FROM aligned GROUP BY unit, year)"""


def _window_names(n: int) -> list[str]:
    return [f"Wk{i:02d}{m}" for m in "AB" for i in range(n)] + [f"Wk{i:02d}Total{m}" for m in "AB" for i in range(1, n)]


ORACLES["aligned_window"] = f"""WITH {_weekly([14])}, {_window_sql(20)}
SELECT u.unit, u.year::INT AS year, u.day::INT AS day, round_even(u.day / 7.0, 0)::DOUBLE AS "WkAnchor",
  {_join(f'p.{c} AS "{c}"' for c in _window_names(20))}
FROM units u LEFT JOIN pivoted p ON u.unit = p.unit AND u.year = p.year"""

ORACLES["attach_record"] = """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
ON o_custkey = c_custkey AND rn = 1"""

ORACLES["row_position"] = """SELECT o_orderkey, o_totalprice,
  row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders"""

ORACLES["stop_epoch"] = f"""WITH t AS (SELECT l_suppkey AS run, l_linenumber - 1 AS epoch, avg(l_extendedprice) AS score
  FROM lineitem GROUP BY ALL),
g AS (SELECT *, lag(score) OVER (PARTITION BY run ORDER BY epoch) - score AS gain,
  row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM t),
s AS (SELECT run, min(k) FILTER (WHERE gain < 200 AND k >= 3) AS stop, max(k) AS last FROM g GROUP BY run)
SELECT s.run, stop AS stop_epoch, k AS kept_epochs, {r('score')} AS score
FROM s JOIN g ON g.run = s.run AND g.k = coalesce(stop - 1, last)"""

# --- profiles ------------------------------------------------------------------------------------

_WIDE_COLS = (["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", "n_lines"]
              + [f"rate{i}" for i in SLOTS] + [f"prod{i}" for i in SLOTS] + [f"date{i}" for i in SLOTS])
ORACLES["null_profile"] = f"WITH {ORDERS_WIDE} " + _join([
    f"SELECT '{c}' AS \"column\", round(count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE, 6) AS null_share FROM wide"
    for c in _WIDE_COLS], " UNION ALL ")

ORACLES["null_columns_dropped"] = f"""WITH {ORDERS_WIDE} SELECT o_orderkey, rate1, prod7 FROM wide"""

ORACLES["label_stats"] = f"""SELECT l_suppkey, {r('min(l_extendedprice)')} AS min, {r('max(l_extendedprice)')} AS max,
  {r('avg(l_extendedprice)')} AS mean, {r('stddev_pop(l_extendedprice)')} AS sd FROM lineitem GROUP BY l_suppkey"""

ORACLES["histogram"] = f"""WITH {ORDERS_WIDE},
v AS (SELECT 'zero' AS nulls, coalesce(rate2, 0) AS v FROM wide UNION ALL SELECT 'exclude', rate2 FROM wide WHERE rate2 IS NOT NULL),
b AS (SELECT nulls, min(v) AS lo, (max(v) - min(v)) / 12 AS width FROM v GROUP BY nulls)
SELECT CAST(least(floor((v - lo) / width), 11) AS INT) AS bin,
  {r('any_value(lo) + least(floor((v - lo) / width), 11) * any_value(width)')} AS low,
  {r('any_value(lo) + (least(floor((v - lo) / width), 11) + 1) * any_value(width)')} AS high, count(*) AS count, nulls
FROM v JOIN b USING (nulls) GROUP BY nulls, least(floor((v - lo) / width), 11)"""

ORACLES["density2d"] = """SELECT CAST(floor(embedding[1]::DOUBLE / 0.05) AS BIGINT) AS cx,
  CAST(floor(embedding[2]::DOUBLE / 0.05) AS BIGINT) AS cy, count(*) AS count FROM embeddings GROUP BY 1, 2"""

def _top(value: str, n: int) -> str:
    return f"""WITH c AS (SELECT {value} AS v, count(*) AS n FROM part GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM c)
SELECT CASE WHEN rn <= {n} THEN v ELSE 'others' END AS value, CAST(sum(n) AS BIGINT) AS count, rn > {n} AS rest FROM k GROUP BY 1, 3"""


ORACLES["top_counts"] = _top("p_brand", 10)
ORACLES["top_counts_named_rest"] = _top("CASE WHEN p_size % 3 = 0 THEN 'others' ELSE p_brand END", 3)


def _spearman(source: str, features: dict[str, str], label: str) -> str:
    parts = _join([f"SELECT '{n}' AS feature, ({e})::DOUBLE AS x, {label} AS y FROM src WHERE ({e}) IS NOT NULL"
                   for n, e in features.items()], " UNION ALL ")
    return f"""{source}, long AS ({parts}),
ranked AS (SELECT feature,
  rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM long)
SELECT feature, {r('abs(corr(rx, ry))', 6)} AS corr FROM ranked GROUP BY feature"""


ORACLES["spearman"] = _spearman(
    "WITH src AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)",
    {"l_quantity": "l_quantity", "l_discount": "l_discount", "tax_open": "CASE WHEN l_returnflag <> 'R' THEN l_tax END",
     "p_size": "p_size", "p_retailprice": "p_retailprice"}, "l_extendedprice")

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
RETURNFLAGS = ("A", "N", "R")


def _dummies() -> dict[str, str]:
    made = {}
    for c, labels in (("o_orderpriority", PRIORITIES), ("prod5", RETURNFLAGS)):
        made |= {f"{c}__DUMMY__{v}": f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for v in labels}
        made[f"{c}__DUMMY__nan"] = f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"
    return made


ORACLES["spearman_dummies"] = _spearman(f"WITH {ORDERS_WIDE}, src AS (SELECT * FROM wide)", _dummies(), "o_totalprice")

ORACLES["response_fit"] = f"""WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mx, avg(l_quantity ** 2) AS mq,
  avg(l_extendedprice) AS my, var_pop(l_quantity) AS sxx, var_pop(l_quantity ** 2) AS sqq,
  covar_pop(l_quantity, l_quantity ** 2) AS sxq, covar_pop(l_quantity, l_extendedprice) AS sxy,
  covar_pop(l_quantity ** 2, l_extendedprice) AS sqy FROM lineitem GROUP BY l_suppkey),
c AS (SELECT *, (sxy * sqq - sqy * sxq) / (sxx * sqq - sxq * sxq) AS c1,
  (sqy * sxx - sxy * sxq) / (sxx * sqq - sxq * sxq) AS c2 FROM m)
SELECT l_suppkey, n, {r('my - c1 * mx - c2 * mq')} AS c0, {r('c1')} AS c1, {r('c2')} AS c2 FROM c"""

# --- categories ----------------------------------------------------------------------------------

ORACLES["category_dictionary"] = _join([
    f"""SELECT '{c}' AS "column", {c} AS label, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS code
FROM (SELECT DISTINCT {c} FROM part)""" for c in ("p_name", "p_brand", "p_type")], " UNION ALL ")

DOCS = """docs AS (SELECT d.doc_id, lang, source, CASE WHEN quality = 1 THEN source END AS good_source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
known AS (SELECT * FROM docs WHERE lang <> 'fr' AND source <> 'src3')"""


def _codes(c: str) -> str:
    return f"""{c}_d AS (SELECT {c} AS label, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS code
  FROM (SELECT DISTINCT {c} FROM known WHERE {c} IS NOT NULL))"""


_CATS = ("lang", "source", "good_source")
ORACLES["category_codes"] = f"""WITH {DOCS}, {_join(_codes(c) for c in _CATS)} SELECT doc_id,
  {_join(f'coalesce({c}_d.code, -1) AS {c}_code, CASE WHEN docs.{c} IS NULL THEN -1 ELSE coalesce({c}_d.code, (SELECT CAST(count(*) AS INT) FROM {c}_d)) END AS {c}_next' for c in _CATS)}
FROM docs {_join([f'LEFT JOIN {c}_d ON docs.{c} = {c}_d.label' for c in _CATS], ' ')}"""

ORACLES["category_labels"] = f"""WITH {DOCS} SELECT doc_id,
  {_join(f'CASE WHEN {c} IN (SELECT {c} FROM known WHERE {c} IS NOT NULL) THEN {c} END AS {c}' for c in _CATS)} FROM docs"""

ORACLES["unknown_labels"] = f"WITH {DOCS} " + _join([
    f"""(SELECT '{c}' AS "column", {c} AS label FROM docs WHERE {c} IS NOT NULL
EXCEPT SELECT '{c}', {c} FROM known)""" for c in _CATS], " UNION ALL ")

ORACLES["split_encode"] = f"""WITH {DOCS}, {_codes('lang')}, hot AS (SELECT doc_id, lang FROM docs)
SELECT doc_id, CAST(lang = 'en' AS INT) AS "lang__DUMMY__en", CAST(lang = 'es' AS INT) AS "lang__DUMMY__es" FROM hot"""

ORACLES["one_hot"] = f"WITH {ORDERS_WIDE} SELECT o_orderkey, " + _join([
    f"CAST(coalesce({c} = '{v}', false) AS INT) AS \"{c}__DUMMY__{v.replace('-', '__').replace(' ', '__')}\""
    for c, labels in (("o_orderpriority", PRIORITIES), ("prod5", RETURNFLAGS)) for v in labels[1:]]
    + [f'CAST({c} IS NULL AS INT) AS "{c}__DUMMY__nan"' for c in ("o_orderpriority", "prod5")]) + " FROM wide"

ORACLES["dummy_model"] = f"""WITH {DOCS}, cells AS (SELECT 'lang' AS c, coalesce(lang, '__na__') AS v FROM docs
  UNION ALL SELECT 'good_source', coalesce(good_source, '__na__') FROM docs),
seen AS (SELECT DISTINCT 'lang' AS c, coalesce(lang, '__na__') AS v FROM known
  UNION SELECT DISTINCT 'good_source', coalesce(good_source, '__na__') FROM known)
SELECT c || '__DUMMY__' || v AS feature, count(*) AS rows FROM cells JOIN seen USING (c, v) GROUP BY c, v"""

ORACLES["sparse_long"] = """WITH per_line AS (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS o_orderkey, 'rate' || l_linenumber AS feature, q AS value FROM per_line WHERE q <> 0
  AND l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, 'n_lines', count(*)::DOUBLE FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey"""

ORACLES["standardize"] = f"""SELECT p_partkey,
  {_join(f'{r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 6)} AS {c}' for c in ("p_size", "p_retailprice"))} FROM part"""

# --- folds ---------------------------------------------------------------------------------------



def _greedy(source: str, group: str, k: int) -> str:
    """CTE ``walk``: one group per step, each to the lightest fold so far."""
    lightest = "list_position(w.loads, list_min(w.loads))"
    return f"""RECURSIVE sizes AS (SELECT {group} AS g, count(*) AS n FROM {source} GROUP BY 1),
ordered AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS k FROM sizes),
walk AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS g, NULL::BIGINT AS n, NULL::INT AS fold, [{_join('0' for _ in range(k))}]::BIGINT[] AS loads
  UNION ALL
  SELECT o.k, o.g, o.n, CAST({lightest} - 1 AS INT),
    list_transform(w.loads, lambda x, i: CASE WHEN i = {lightest} THEN x + o.n ELSE x END)
  FROM walk w JOIN ordered o ON o.k = w.k + 1)"""


ORACLES["group_kfold"] = f"""WITH {_greedy('orders', 'o_custkey', 5)}
SELECT g AS o_custkey, fold, n AS n_rows FROM walk WHERE k > 0"""

ORACLES["hash_fold"] = """SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, 0::BIGINT AS split,
  0 AS first_fold, 3 AS last_fold FROM orders"""

ORACLES["leakage_check"] = "SELECT 0::BIGINT AS shared, unnest([0, 1, 2]) AS fold"

# --- scores --------------------------------------------------------------------------------------


def _moments(pred: str = "pred", places: int = 4, square_places: int = 4) -> str:
    e, p = f"abs(y - {pred})", f"(abs(y - {pred}) / nullif(y, 0) * 100)"
    cells = {
        "r2": f"1 - sum({e} ** 2) / (var_pop(y) * count(*))", "abs_mean": f"avg({e})", "abs_std": f"stddev_pop({e})",
        "abs_max": f"max({e})", "abs_std_3": f"avg({e}) + 3 * stddev_pop({e})", "percent_mean": f"avg({p})",
        "percent_std": f"stddev_pop({p})", "percent_max": f"max({p})", "abs_median": f"median({e})",
        "abs_p90": f"quantile_cont({e}, 0.9)", "abs_p95": f"quantile_cont({e}, 0.95)", "abs_p99": f"quantile_cont({e}, 0.99)"}
    return _join(["count(*) AS n_samples", f"{r(f'avg({e} ** 2)', square_places)} AS sq_mean",
                  *[f"{r(v, places)} AS {k}" for k, v in cells.items()]])


ORACLES["score_report"] = f"WITH {PREDS} SELECT {_moments()} FROM preds"
ORACLES["score_by_unit"] = f"WITH {PREDS} SELECT unit, {_moments(places=6, square_places=2)} FROM preds GROUP BY unit"
ORACLES["score_pooled"] = f"WITH {PREDS} SELECT {_moments()} FROM preds"
ORACLES["score_bounds"] = f"""WITH {ERRORS} SELECT fold, {r('1 - sum(err ** 2) / (var_pop(y) * count(*))')} AS r2,
  {r('avg(err ** 2)')} AS sq_mean, {r('avg(err)')} AS abs_mean, {r('stddev_pop(err)')} AS abs_std, {r('max(err)')} AS abs_max,
  {r('avg(err) + 2 * stddev_pop(err)')} AS abs_2std_95, {r('avg(err) + 3 * stddev_pop(err)')} AS abs_3std_99,
  {r('avg(pct)')} AS percent_mean, {r('stddev_pop(pct)')} AS percent_std, {r('max(pct)')} AS percent_max,
  {r('avg(pct) + 2 * stddev_pop(pct)')} AS percent_2std_95, {r('avg(pct) + 3 * stddev_pop(pct)')} AS percent_3std_99
FROM errors GROUP BY fold"""
ORACLES["loss_by_fold"] = f"WITH {ERRORS} SELECT fold, {r('avg(err) + 2 * stddev_pop(err)')} AS loss FROM errors GROUP BY fold"
ORACLES["holdout_report"] = f"""WITH {ERRORS} SELECT fold, {r('avg(err)')} AS abs_mean, {r('quantile_cont(err, 0.95)')} AS abs_p95,
  {r('avg(pct)')} AS percent_mean, {r('quantile_cont(pct, 0.95)')} AS percent_p95 FROM errors GROUP BY fold"""

ORACLES["baseline_score"] = f"""WITH {PREDS}, guesses AS (
  SELECT 'train' AS mean_from, avg(y) AS g FROM preds WHERE l_linestatus = 'F'
  UNION ALL SELECT 'test', avg(y) FROM preds WHERE l_linestatus = 'O' UNION ALL SELECT 'all', avg(y) FROM preds)
SELECT mean_from, {_moments('g')} FROM preds, guesses WHERE l_linestatus = 'O' GROUP BY mean_from"""

ORACLES["baseline_by_fold"] = f"""WITH {PREDS},
others AS (SELECT a.fold, avg(b.y) AS g FROM (SELECT DISTINCT fold FROM preds) a JOIN preds b ON a.fold <> b.fold GROUP BY a.fold)
SELECT preds.fold, {_moments('g')} FROM preds JOIN others ON preds.fold = others.fold GROUP BY preds.fold"""

GRID = ERRORS + """, grid AS (SELECT l_returnflag, l_linestatus, fold, avg(err) + 3 * stddev_pop(err) AS score,
  avg(err) AS abs_mean, count(*) AS iteration FROM errors GROUP BY ALL)"""
ORACLES["cv_summary"] = f"""WITH {GRID} SELECT l_returnflag, l_linestatus, {r('avg(score)')} AS score,
  {r('avg(abs_mean)')} AS abs_mean, CAST(round_even(avg(iteration), 0) AS INT) AS best_iteration FROM grid GROUP BY 1, 2"""
ORACLES["best_params"] = f"""WITH {GRID}, s AS (SELECT l_returnflag, l_linestatus, avg(score) AS score FROM grid GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, {r('score')} AS score FROM s WHERE score = (SELECT min(score) FROM s)"""

ORACLES["importance_merge"] = """SELECT 'l_returnflag' AS feature, count(*) AS weight FROM lineitem
UNION ALL SELECT 'l_linestatus', count(*) FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_quantity > 25
UNION ALL SELECT 'l_discount', count(*) FROM lineitem WHERE l_discount > 0.05 AND l_linenumber <= 4"""

ORACLES["topn_ties"] = """SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k FROM part)
WHERE k <= 30"""

ORACLES["unit_report"] = f"""WITH {PREDS} SELECT unit, fold, {r('y')} AS actual, {r('pred')} AS predicted,
  {r('abs(y - pred)')} AS abs_diff FROM preds"""

# --- joins, geometry -----------------------------------------------------------------------------

ORACLES["assemble"] = """SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority, p_brand, p_size, c_mktsegment,
  n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag IN ('A', 'N') AND l_shipdate IS NOT NULL AND l_extendedprice > 0"""

_AREA = "CASE WHEN kind = 0 THEN w * h - qw * qh WHEN kind <= 2 THEN w * h ELSE w * h / 2.0::DOUBLE END"
_CX = (f"CASE WHEN kind = 0 THEN ((w * h) * (x + w / 2.0::DOUBLE) - qw * qh * (x + 1.5::DOUBLE * qw)) / ({_AREA}) "
       "WHEN kind <= 2 THEN x + w / 2.0::DOUBLE ELSE x + w / 3.0::DOUBLE END")
_CY = (f"CASE WHEN kind = 0 THEN ((w * h) * (y + h / 2.0::DOUBLE) - qw * qh * (y + 1.5::DOUBLE * qh)) / ({_AREA}) "
       "WHEN kind <= 2 THEN y + h / 2.0::DOUBLE ELSE y + h / 3.0::DOUBLE END")
ORACLES["xml_geometry"] = f"""WITH {SHAPES} SELECT id AS shape_id, {r('x / 1000.0::DOUBLE', 9)} AS xml_xmin,
  {r('y / 1000.0::DOUBLE', 9)} AS xml_ymin, CASE WHEN kind = 0 THEN 2 ELSE 1 END AS n_rings,
  {r(f'({_AREA}) / 1e6', 9)} AS area, {r(f'({_CX}) / 1000', 9)} AS cx, {r(f'({_CY}) / 1000', 9)} AS cy,
  {r('(x + w) / 1000.0::DOUBLE', 9)} AS xmax, {r('(y + h) / 1000.0::DOUBLE', 9)} AS ymax FROM shp"""

ORACLES["spatial_semi"] = f"""WITH {SHAPES} SELECT id AS shape_id, s_acctbal FROM shp WHERE id IN (SELECT id FROM held)"""

ORACLES["holdout_assembly"] = f"""WITH {SHAPES}, firsts AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
SELECT id AS shape_id, id AS unit, l_quantity, CAST(l_returnflag = 'A' AS INT) AS "l_returnflag__DUMMY__a",
  0 AS "l_returnflag__DUMMY__zz", s_acctbal, 0.0::DOUBLE AS absent
FROM shp JOIN firsts ON id = l_suppkey AND rn = 1 WHERE id IN (SELECT id FROM held)"""

# --- compositions --------------------------------------------------------------------------------

_N = 6
_WIN = _window_names(_N)
_TOTAL = " + ".join(f"coalesce(rate{i}, 0)" for i in range(1, 5))
_COUNT = " + ".join(f"(prod{i} IS NOT NULL)::INT" for i in range(1, 5))


def _season(biweek: bool, conditional: bool) -> str:
    labels = [f"{_biweek(f'date{i}')} AS date{i}_biweek" for i in range(1, 5)] if biweek else []
    delta = "CASE WHEN rate6 > rate5 THEN rate6 - rate5 END" if conditional else "rate6 - rate5"
    cols = [
        "year(o_orderdate)::INT AS year", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        "n_lines", "rate7", "date6", "date7", "u.day::INT AS day", *labels,
        "prod5 IS NOT NULL AND date5 IS NOT NULL AS Slot5_exists", "prod6 IS NOT NULL AND prod7 IS NOT NULL AS Tail_exists",
        f"{_TOTAL} AS Line_TotalRate", f"{_COUNT} AS Line_Count", "round_even(u.day / 7.0, 0)::DOUBLE AS WkAnchor",
        *[f"p.{c} AS {c}" for c in _WIN], f"{delta} AS Rate_Prev"]
    return f"""{ORDERS_WIDE}, {_weekly([14])}, {_window_sql(_N)},
shaped AS (SELECT {_join(cols)} FROM wide
  LEFT JOIN units u ON u.unit = o_custkey AND u.year = year(o_orderdate)
  LEFT JOIN pivoted p ON p.unit = u.unit AND p.year = u.year)"""


ORACLES["shape"] = f"""WITH {_season(True, True)} SELECT * REPLACE (round(o_totalprice, 2) AS o_totalprice) FROM shaped"""

_FLOATS = ["Line_TotalRate", "WkAnchor", *_WIN, "Rate_Prev"]
_FEATURES = ["day", "Line_TotalRate", "Line_Count", "WkAnchor", *_WIN, "Rate_Prev"]
_STATS = [*_FEATURES, "o_totalprice"]


def _long(source: str, numeric: list[str], labels: list[str], places: int) -> str:
    parts = [f"SELECT o_orderkey, '{c}' AS feature, {r(c, places)} AS value FROM {source} WHERE {c} IS NOT NULL AND {c} <> 0"
             for c in numeric]
    parts += [f"""SELECT o_orderkey, '{c}__DUMMY__' || lower(CAST({c} AS VARCHAR)), 1.0::DOUBLE FROM {source}
  WHERE {c} IS NOT NULL AND lower(CAST({c} AS VARCHAR)) NOT IN ('', 'none', 'nan', 'null')""" for c in labels]
    return " UNION ALL ".join(parts)


_LABELS = ["o_orderstatus", "o_orderpriority", "Slot5_exists", "Tail_exists"]
ORACLES["feature_matrix"] = f"""WITH {_season(False, True)},
filled AS (SELECT o_orderkey, {_join(_LABELS)}, year,
  {_join(f'coalesce({c}, avg({c}) OVER ())::DOUBLE AS {c}' for c in _STATS)} FROM shaped),
capped AS (SELECT * FROM filled WHERE o_totalprice <= 450000),
q AS (SELECT {_join(f'quantile_cont({c}, 0.002) AS lo_{c}, quantile_cont({c}, 0.998) AS hi_{c}' for c in _STATS)} FROM capped),
kept AS (SELECT capped.* FROM capped, q
  WHERE {_join([f'{c} BETWEEN lo_{c} AND hi_{c}' for c in _STATS], ' AND ')})
{_long('kept', _FEATURES, [*_LABELS, 'year'], 3)}"""

ORACLES["feature_matrix_raw"] = f"""WITH {_season(True, False)}
{_long('shaped', _FEATURES, [*_LABELS, 'year', *[f'date{i}_biweek' for i in range(1, 5)]], 2)}"""

ORACLES["label_form"] = f"WITH {ORDERS_WIDE} SELECT o_orderkey, coalesce(rate1, 0.0) AS rate1, coalesce(rate5, 0.0) AS rate5, " + _join([
    f"CAST(coalesce({c} = '{v}', false) AS INT) AS \"{c}__DUMMY__{v.lower().replace('-', '__').replace(' ', '__')}\""
    for c, labels in (("o_orderpriority", PRIORITIES), ("prod5", RETURNFLAGS)) for v in labels]) + " FROM wide"

ORACLES["group_cells"] = f"""WITH {_season(True, True)}, cells AS ({_join([
    f'SELECT DISTINCT {c!r} AS c, lower(CAST({c} AS VARCHAR)) AS v FROM shaped' for c in
    [*_LABELS, *[f'date{i}_biweek' for i in range(1, 5)]]], ' UNION ALL ')})
SELECT c AS "column", v AS label, CAST(row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS INT) AS code
FROM cells WHERE v IS NOT NULL AND v NOT IN ('', 'none', 'nan', 'null')"""

# --- what-if -------------------------------------------------------------------------------------

_SWEEP = f"""{LEARN},
b AS (SELECT CAST(round_even(avg(l_quantity) - 2.5 * stddev_samp(l_quantity), 0) AS INT) AS lo,
  CAST(round_even(avg(l_quantity) + 2.5 * stddev_samp(l_quantity), 0) AS INT) AS hi FROM learn WHERE l_quantity BETWEEN 10 AND 40),
grid AS (SELECT unnest(range(lo, hi, 5))::DOUBLE AS g FROM b),
curve AS (SELECT learn.*, g, 120 - 0.05::DOUBLE * (g - (20 + p_size / 5.0::DOUBLE)) ** 2 + 0.8::DOUBLE * p_size AS p FROM learn, grid)"""
ORACLES["whatif_best"] = f"""WITH {_SWEEP} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_size,
  min(g) FILTER (WHERE p = top) AS best, {r('max(p)')} AS prediction
FROM (SELECT *, max(p) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS top FROM curve)
GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, p_size"""
ORACLES["whatif_curve"] = f"""WITH {_SWEEP} SELECT l_suppkey, g AS l_quantity, {r('avg(p)', 10)} AS response FROM curve GROUP BY 1, 2"""

# --- models --------------------------------------------------------------------------------------

ORACLES["nested_cv"] = f"""WITH {_greedy('lineitem', 'l_suppkey', 3)}
SELECT fold, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, true AS beats_mean FROM walk WHERE k > 0 GROUP BY fold"""
ORACLES["stacking"] = """SELECT unnest(['boosted', 'forest', 'stacked']) AS model, (SELECT count(*) FROM lineitem) AS n_samples,
  true AS beats_mean"""
ORACLES["leaderboard"] = """SELECT unnest(['boosted', 'forest', 'elastic_net']) AS model,
  (SELECT count(*) FROM lineitem) AS n_samples, true AS beats_mean"""
ORACLES["model_search"] = """SELECT number::INTEGER AS number, CASE WHEN number < 2 THEN 'boosted' ELSE 'forest' END AS family,
  CASE WHEN number < 4 THEN 'done' ELSE 'skipped' END AS state, CASE WHEN number < 4 THEN 2 ELSE 0 END AS folds_done,
  CASE WHEN number < 4 THEN (SELECT count(*) FROM lineitem) END AS n_samples, CASE WHEN number < 4 THEN true END AS beats_mean FROM range(6) t(number)"""
ORACLES["tree_importance"] = "SELECT unnest(['weight', 'gain']) AS kind, true AS complete, 'l_quantity' AS top"
ORACLES["error_trace"] = "SELECT unnest(['train', 'test']) AS dataset, 6::BIGINT AS iterations, true AS fell"
ORACLES["decision_paths"] = "SELECT unnest([0, 1]) AS tree, count(*) AS leaves, count(*) AS starts, 0::BIGINT AS broken FROM lineitem"
ORACLES["decision_replay"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM lineitem"
ORACLES["extra_trees"] = "SELECT unnest([0, 1, 2, 3])::INTEGER AS tree, count(*) AS n_rows, 0::BIGINT AS off_cuts, 0::BIGINT AS off_nodes, true AS beats_mean FROM lineitem"
ORACLES["boosted_missing"] = """SELECT count(*) AS n_rows, 0::BIGINT AS n_off, true AS better, round(avg(120 - 0.05::DOUBLE * (l_quantity - 30) ** 2 + 0.8::DOUBLE * p_size
  + ((l_partkey * 7919 + l_linenumber * 104729) % 20 - 10)), 3) AS base FROM lineitem JOIN part ON l_partkey = p_partkey"""
ORACLES["whatif_steps"] = "SELECT count(*) AS n_rows, count(*) AS n_equal, count(*) AS near_optimum FROM lineitem"
ORACLES["whatif_model"] = "SELECT count(*) AS n_rows, count(*) AS near_optimum FROM lineitem"


# --- the same results by other plans, and round trips ------------------------------------------------

for _name, _like in (("outliers_bracketed", "outliers"), ("holdout_report_bracketed", "holdout_report"), ("spatial_split", "spatial_semi"), ("spatial_dealt", "spatial_semi"),
                     ("feature_set_round_trip", "feature_matrix"), ("feature_model_round_trip", "feature_matrix")):
    ORACLES[_name] = ORACLES[_like]

ORACLES["fill_not_a_number"] = f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p
  FROM orders),
s AS (SELECT avg(p) AS m, avg(p) + stddev_samp(p) AS high, greatest(0, avg(p) - stddev_samp(p)) AS low, quantile_cont(p, 0.1) AS q1,
  quantile_cont(p, 0.9) AS q9 FROM o)
SELECT o_orderkey, {r('coalesce(p, m)', 3)} AS price, {r('CASE WHEN p IS NOT NULL THEN least(greatest(p, low), high) END', 3)} AS clamped,
  CASE WHEN p BETWEEN q1 AND q9 THEN 1 END AS kept FROM o, s"""

ORACLES["range_rows"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 20000 AND 60000"
ORACLES["parameter_rows"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
ORACLES["first_rows"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"

ORACLES["row_position_ties"] = """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT *, CAST(sum(n) OVER (ORDER BY o_orderpriority) AS BIGINT) AS upto FROM c)
SELECT o_orderpriority, upto - n AS first, upto - 1 AS last, n FROM s"""

ORACLES["average_ranks_sliced"] = f"""WITH c AS (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, {r('(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - n) + (n + 1) / 2.0::DOUBLE', 2)} AS rank FROM c"""

ORACLES["stop_epoch_gaps"] = f"""WITH t AS (SELECT l_suppkey AS run, l_linenumber AS epoch, avg(l_extendedprice) AS score
  FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL),
g AS (SELECT *, lag(score) OVER (PARTITION BY run ORDER BY epoch) - score AS gain,
  row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM t),
s AS (SELECT run, min(k) FILTER (WHERE gain < 200 AND k >= 2) AS stop, max(k) AS last FROM g GROUP BY run)
SELECT s.run, stop AS stop_epoch, k AS kept_epochs, {r('score')} AS score
FROM s JOIN g ON g.run = s.run AND g.k = coalesce(stop - 1, last)"""

ORACLES["spearman_nulls"] = _spearman("WITH src AS (SELECT * FROM lineitem)", {
    f"c{k}": f"CASE WHEN l_suppkey % 10 <> {k} THEN (l_quantity * {k + 3} + l_linenumber * 7) % {11 + k} END" for k in range(10)}, "l_extendedprice")

ORACLES["response_fit_few"] = f"""WITH d AS (SELECT l_suppkey, least(l_linenumber, l_suppkey % 4 + 1)::DOUBLE AS x, l_extendedprice AS y FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT x) AS places, avg(x) AS mx, avg(x ** 2) AS mq, avg(y) AS my, var_pop(x) AS sxx,
  var_pop(x ** 2) AS sqq, covar_pop(x, x ** 2) AS sxq, covar_pop(x, y) AS sxy, covar_pop(x ** 2, y) AS sqy FROM d GROUP BY l_suppkey),
c AS (SELECT *, CASE WHEN places >= 3 THEN (sxy * sqq - sqy * sxq) / (sxx * sqq - sxq * sxq) END AS c1,
  CASE WHEN places >= 3 THEN (sqy * sxx - sxy * sxq) / (sxx * sqq - sxq * sxq) END AS c2 FROM m)
SELECT l_suppkey, n, {r('my - c1 * mx - c2 * mq', 2)} AS c0, {r('c1', 2)} AS c1, {r('c2', 2)} AS c2 FROM c"""

ORACLES["split_vector"] = """WITH p AS (SELECT p_partkey % 3 = 0 AS test, p_name AS a, CASE WHEN p_size % 4 <> 0 THEN p_type END AS b FROM part),
n AS (SELECT count(DISTINCT a) + count(DISTINCT b) AS entries FROM p WHERE NOT test)
SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS side, max(entries) AS entries,
  count(*) FILTER (WHERE a IN (SELECT a FROM p WHERE NOT test)) + count(*) FILTER (WHERE b IN (SELECT b FROM p WHERE NOT test AND b IS NOT NULL)) AS hits
FROM p, n GROUP BY test"""

ORACLES["standardize_nulls"] = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END::DOUBLE AS a,
  CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS b FROM part),
f AS (SELECT p_partkey, coalesce(a, avg(a) OVER ()) AS a, coalesce(b, avg(b) OVER ()) AS b FROM p)
SELECT p_partkey, {r('(a - avg(a) OVER ()) / stddev_samp(a) OVER ()', 5)} AS size, {r('(b - avg(b) OVER ()) / stddev_samp(b) OVER ()', 5)} AS price FROM f"""

ORACLES["group_kfold_nulls"] = """SELECT count(*) AS tested, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS without,
  count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END) AS groups, 0 AS split FROM orders"""

ORACLES["category_codes_joined"] = """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS v FROM part),
d AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM (SELECT DISTINCT v FROM p WHERE p_partkey % 2 = 0 AND v IS NOT NULL))
SELECT p_partkey, coalesce(code, -1) AS p_name, d.v AS label FROM p LEFT JOIN d ON p.v = d.v"""

ORACLES["spatial_parts"] = f"""WITH s AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 41 - 20) / 20.0::DOUBLE AS x, ((s_suppkey * 53) % 41 - 20) / 20.0::DOUBLE AS y
  FROM supplier), p AS (SELECT embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings)
SELECT id AS shape_id, 0.109375::DOUBLE AS area, CASE WHEN EXISTS (SELECT 1 FROM p WHERE
  (px BETWEEN x AND x + 0.25 AND py BETWEEN y AND y + 0.25 AND NOT (px > x + 0.0625 AND px < x + 0.1875 AND py > y + 0.0625 AND py < y + 0.1875))
  OR (px BETWEEN x + 0.5 AND x + 0.75 AND py BETWEEN y AND y + 0.25)) THEN 1 END AS held FROM s"""

ORACLES["forest_epochs"] = "SELECT count(*) AS n_samples, true AS beats_mean, true AS trees, true AS gains, true AS replayed FROM lineitem"

ORACLES["csv_round_trip"] = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' pad ' WHEN 2 THEN 'a' || chr(10) || 'b' || chr(13) || chr(10) || '"c"'
  WHEN 3 THEN chr(92) || 'N' || chr(9) || ',' || chr(92) WHEN 4 THEN NULL ELSE o_orderpriority END AS text, o_totalprice, o_orderdate FROM orders"""
ORACLES["cells_round_trip"] = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
ORACLES["table_round_trip"] = "SELECT o_orderkey, o_totalprice, o_orderstatus, true AS same FROM orders"
ORACLES["id_list_complement"] = """SELECT o_orderkey, CAST(o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AS INT) AS listed
  FROM orders"""
ORACLES["unit_files"] = "SELECT count(*) AS n_rows, count(*) AS n_right FROM orders"
ORACLES["model_round_trip"] = "SELECT count(*) AS n_rows, count(*) AS n_same, true AS evaluated FROM lineitem"

ORACLES["biweek_spellings"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN '_May 3_'
  ELSE CAST(CAST(ceil(dayofyear(o_orderdate) / 14.0) AS INT) AS VARCHAR) END AS d_biweek FROM orders"""
ORACLES["sparse_blocks"] = ORACLES["sparse_long"]

ORACLES["label_vectors"] = """WITH lines AS (SELECT l_shipdate < TIMESTAMP '1999-01-01' AS known, CAST(l_orderkey AS VARCHAR) AS o,
  CASE WHEN l_quantity <= 45 THEN l_returnflag END AS f FROM lineitem),
cells AS (SELECT known, 0 AS c, 'order__DUMMY__' || o AS feature, o AS label FROM lines
  UNION ALL SELECT known, 1, 'flag__DUMMY__' || coalesce(f, '__na__'), f FROM lines),
seen AS (SELECT *, row_number() OVER (ORDER BY c, label NULLS FIRST) - 1 AS entry FROM (SELECT DISTINCT c, feature, label FROM cells WHERE known))
SELECT entry, feature, count(*) AS rows FROM cells JOIN seen USING (c, feature) GROUP BY entry, feature"""
