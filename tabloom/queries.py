"""The queries over the order table and its neighbours, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import privacy, probability, rng
from tabloom.operators import constrained, dependency, evaluate, flows, learning, marginals, model, profile, repair, sampling, transform, violations
from tabloom.plans import sequence as seq
from tabloom.plans.constraint import DenialConstraint
from tabloom.sources.shared import checkpoint, shared_folder
from tabloom.sources.tables import ORDER_WIDE_SQL, order_wide, read_csv, save_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FDS = [
    "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&IQ(t1.c_nationkey,t2.c_nationkey)",
    "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&IQ(t1.c_mktsegment,t2.c_mktsegment)",
    "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&IQ(t1.n_name,t2.n_name)",
    "t1&t2&EQ(t1.n_name,t2.n_name)&IQ(t1.n_regionkey,t2.n_regionkey)",
]
BROKEN = "t1&t2&EQ(t1.c_nationkey,t2.c_nationkey)&IQ(t1.o_orderstatus,t2.o_orderstatus)"
TWO_IQ = "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&IQ(t1.o_orderstatus,t2.o_orderstatus)&IQ(t1.o_orderpriority,t2.o_orderpriority)"
EQ_ONLY = "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&EQ(t1.o_orderpriority,t2.o_orderpriority)"
IQ_ONLY = "t1&t2&IQ(t1.o_orderstatus,t2.o_orderstatus)&IQ(t1.o_orderpriority,t2.o_orderpriority)"
EQ_ORDER = "t1&t2&EQ(t1.c_custkey,t2.c_custkey)&GT(t1.o_totalprice,t2.o_totalprice)&LT(t1.o_orderdate,t2.o_orderdate)"
HOT_ORDER = "t1&t2&EQ(t1.c_mktsegment,t2.c_mktsegment)&GT(t1.o_totalprice,t2.o_totalprice)&LT(t1.c_acctbal,t2.c_acctbal)"
ORDER_ONLY = "t1&t2&LT(t1.o_totalprice,t2.o_totalprice)&GT(t1.c_acctbal,t2.c_acctbal)"
RAW_ORDER = "t1&t2&LT(t1.o_totalprice,t2.o_totalprice)&GT(t1.o_orderdate,t2.o_orderdate)"
MIXED = "t1&t2&IQ(t1.o_orderstatus,t2.o_orderstatus)&LTE(t1.c_acctbal,t2.c_acctbal)&GTE(t1.c_custkey,t2.c_custkey)&EQ(t1.c_nationkey,t2.c_nationkey)"
IQ_ORDER = "t1&t2&IQ(t1.o_orderstatus,t2.o_orderstatus)&LT(t1.o_totalprice,t2.o_totalprice)"
THREE_ORDERS = "t1&t2&LT(t1.o_totalprice,t2.o_totalprice)&GT(t1.c_acctbal,t2.c_acctbal)&LTE(t1.o_orderdate,t2.o_orderdate)"
THETA = "t1&t2&LT(t1.o_totalprice,t2.c_acctbal)&GT(t1.o_orderdate,t2.o_orderdate)"
THETA_KEY = "t1&t2&EQ(t1.n_regionkey,t2.c_nationkey)&GTE(t1.o_totalprice,t2.c_acctbal)&IQ(t1.o_orderstatus,t2.o_orderstatus)"
THETA_CONSTANT = 't1&t2&EQ(t1.o_orderstatus,"F")&GT(t2.o_totalprice,250000)&LT(t1.c_acctbal,t2.c_acctbal)'
ONE_TUPLE = 't1&GT(t1.o_totalprice,200000)&EQ(t1.o_orderstatus,"F")'
ALL = [*FDS, BROKEN, TWO_IQ, EQ_ONLY, IQ_ONLY, EQ_ORDER, ONE_TUPLE]
dc = DenialConstraint.parse


def _pairs_sql(text: str, mode: str = "<", table: str = "wide") -> str:
    c = dc(text)
    return f"SELECT count(*) AS n FROM {table} t1 JOIN {table} t2 ON t1.tid {mode} t2.tid AND {c.sql()}" if c.two_tuple else f"SELECT count(*) AS n FROM {table} t1 WHERE {c.sql()}"


def _count_sql(text: str, mode: str = "<") -> str:
    return f"WITH {ORDER_WIDE_SQL} SELECT n AS n_vio FROM ({_pairs_sql(text, mode)})"


def _report_sql(texts: list[str]) -> str:
    parts = []
    for t in texts:
        pairs = "n_rows * (n_rows - 1) // 2" if dc(t).two_tuple else "n_rows"
        quoted = str(dc(t)).replace("'", "''")
        parts.append(f"SELECT '{quoted}' AS dc, n AS n_vio, {pairs} AS n_pair, CAST(round(n / ({pairs}), 3) AS DOUBLE) AS ratio FROM ({_pairs_sql(t)}), (SELECT count(*) AS n_rows FROM wide)")
    return f"WITH {ORDER_WIDE_SQL} " + " UNION ALL ".join(parts)


# --- violations ----------------------------------------------------------------------------------


@query(_report_sql(FDS))
def fd_report(spark, sf_dir):
    return violations.violation_report(order_wide(spark, sf_dir), [dc(t) for t in FDS])


@query(_report_sql(ALL))
def report_all_shapes(spark, sf_dir):
    return violations.violation_report(order_wide(spark, sf_dir), [dc(t) for t in ALL])


def _count(name: str, text: str, mode: str = "tid_ordered") -> None:
    def run(spark, sf_dir):
        return violations.count_violations(order_wide(spark, sf_dir), dc(text), mode=mode)

    run.__name__ = name
    query(_count_sql(text, "<" if mode == "tid_ordered" else "<>"))(run)


_count("vio_fd_single", BROKEN)
_count("vio_fd_two_iq", TWO_IQ)
_count("vio_eq_only", EQ_ONLY)
_count("vio_iq_only", IQ_ONLY)
_count("vio_eq_order", EQ_ORDER)
_count("vio_hot_key_order", HOT_ORDER)
_count("vio_order_only", ORDER_ONLY)
_count("vio_mixed", MIXED)
_count("vio_one_tuple", ONE_TUPLE)
_count("vio_iq_order", IQ_ORDER)
_count("vio_three_orders", THREE_ORDERS)
_count("vio_theta", THETA)
_count("vio_theta_key", THETA_KEY)
_count("vio_theta_constant", THETA_CONSTANT)
_count("vio_theta_ordered_mode", THETA, "ordered")
_count("vio_fd_ordered_mode", BROKEN, "ordered")
_count("vio_eq_order_ordered_mode", EQ_ORDER, "ordered")


@query("""SELECT count(*) AS n_vio FROM orders t1 JOIN orders t2 ON t1.o_orderkey < t2.o_orderkey AND t1.o_totalprice < t2.o_totalprice AND t1.o_orderdate > t2.o_orderdate""")
def vio_order_only_raw(spark, sf_dir):
    return violations.count_violations(spark.read.parquet(f"{sf_dir}/orders.parquet"), dc(RAW_ORDER), tid="o_orderkey")


def _rows_sql(text: str) -> str:
    return f"""WITH {ORDER_WIDE_SQL}, v AS (SELECT t1.tid, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(text).sql()} GROUP BY t1.tid)
    SELECT wide.tid, coalesce(n, 0) AS n FROM wide LEFT JOIN v USING (tid)"""


@query(_rows_sql(TWO_IQ))
def row_violations_fd(spark, sf_dir):
    return violations.row_violations(order_wide(spark, sf_dir), dc(TWO_IQ))


@query(_rows_sql(EQ_ORDER))
def row_violations_order(spark, sf_dir):
    return violations.row_violations(order_wide(spark, sf_dir), dc(EQ_ORDER))


@query(_rows_sql(ORDER_ONLY))
def row_violations_order_only(spark, sf_dir):
    return violations.row_violations(order_wide(spark, sf_dir), dc(ORDER_ONLY))


@query(_rows_sql(THETA_KEY))
def row_violations_theta(spark, sf_dir):
    return violations.row_violations(order_wide(spark, sf_dir), dc(THETA_KEY))


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, o_totalprice FROM wide t1 WHERE EXISTS (SELECT 1 FROM wide t2 WHERE t1.tid <> t2.tid AND {dc(THETA).sql()})")
def violating_rows_theta(spark, sf_dir):
    return violations.violating_rows(order_wide(spark, sf_dir), dc(THETA)).select("tid", "o_totalprice")


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, o_totalprice FROM wide t1 WHERE EXISTS (SELECT 1 FROM wide t2 WHERE t1.tid <> t2.tid AND {dc(EQ_ORDER).sql()})")
def violating_rows(spark, sf_dir):
    return violations.violating_rows(order_wide(spark, sf_dir), dc(EQ_ORDER)).select("tid", "o_totalprice")


@query(f"""WITH {ORDER_WIDE_SQL}, v AS (
  SELECT t1.tid, 0 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(TWO_IQ).sql()} GROUP BY t1.tid UNION ALL
  SELECT t1.tid, 1 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(EQ_ORDER).sql()} GROUP BY t1.tid)
  SELECT wide.tid, CAST(d.dc AS INTEGER) AS dc, coalesce(v.n, 0) AS n FROM wide CROSS JOIN (VALUES (0), (1)) d(dc) LEFT JOIN v ON v.tid = wide.tid AND v.dc = d.dc""")
def violation_matrix(spark, sf_dir):
    return violations.violation_matrix(order_wide(spark, sf_dir), [dc(TWO_IQ), dc(EQ_ORDER)])


# --- profile -------------------------------------------------------------------------------------

COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey", "o_orderpriority", "o_totalprice", "o_orderstatus"]
NUMBERS = ["c_acctbal", "o_totalprice"]


@query(f"WITH {ORDER_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS attr, count(DISTINCT {c}) AS size FROM wide" for c in COLUMNS))
def domain_sizes(spark, sf_dir):
    return profile.domain_sizes(order_wide(spark, sf_dir), COLUMNS)


@query(f"WITH {ORDER_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM wide" for c in NUMBERS))
def attribute_ranges(spark, sf_dir):
    return profile.ranges(order_wide(spark, sf_dir), NUMBERS)


@query(f"WITH {ORDER_WIDE_SQL} SELECT o_orderpriority AS value, count(*) AS n FROM wide GROUP BY 1")
def value_histogram(spark, sf_dir):
    return profile.histogram(order_wide(spark, sf_dir), "o_orderpriority")


_IN_FD = ", ".join(f"'{c}'" for c in dict.fromkeys(a for t in FDS for a in dc(t).attributes))
_WHOLE = ["c_custkey", "c_nationkey", "n_regionkey"]


@query(f"WITH {ORDER_WIDE_SQL}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS attr, {c in NUMBERS + _WHOLE} AS number, {c in _WHOLE} AS whole, {f'CAST(max({c}) - min({c}) AS DOUBLE)' if c in NUMBERS + _WHOLE else 'max(0.0::DOUBLE)'} AS span FROM wide" for c in COLUMNS)
       + f") SELECT attr, CASE WHEN number AND attr NOT IN ({_IN_FD}) AND NOT (whole AND span < 200) THEN 'numeric' ELSE 'categorical' END AS role FROM r")
def attribute_roles(spark, sf_dir):
    found = profile.attribute_roles(order_wide(spark, sf_dir), [dc(t) for t in FDS], COLUMNS)
    return spark.createDataFrame(list(found.items()), "attr string, role string")


_SIDES = ", ".join(f"({i}, {side}, '{a}')" for i, t in enumerate(FDS) for side, op in enumerate(("=", "<>")) for a in dc(t).of(op))


@query(f"""WITH {ORDER_WIDE_SQL}, sizes AS ({" UNION ALL ".join(f"SELECT '{c}' AS attr, {'max(100)' if c in NUMBERS else f'count(DISTINCT {c})'} AS size FROM wide" for c in COLUMNS)}),
sides(fd, side, attr) AS (VALUES {_SIDES}), least AS (SELECT fd, min(size) AS least FROM sides JOIN sizes USING (attr) WHERE side = 0 GROUP BY 1),
walk AS (SELECT attr, row_number() OVER (ORDER BY least, fd, side, size, attr) AS step FROM sides JOIN sizes USING (attr) JOIN least USING (fd)),
held AS (SELECT attr, min(step) AS step FROM walk GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY step IS NULL, step, size, attr) - 1 AS INTEGER) AS pos, attr FROM sizes LEFT JOIN held USING (attr)""")
def attribute_sequence(spark, sf_dir):
    order = profile.attribute_sequence(order_wide(spark, sf_dir), [dc(t) for t in FDS], COLUMNS, {"c_acctbal": 100, "o_totalprice": 100})
    return spark.createDataFrame(list(enumerate(order)), "pos int, attr string")


@query("SELECT attr, CAST(dc AS INTEGER) AS dc FROM (VALUES ('n_regionkey', 3), ('c_nationkey', 0), ('c_mktsegment', 1), ('c_custkey', 2)) t(attr, dc)")
def relevant_constraints(spark, sf_dir):
    order = ["n_name", "n_regionkey", "c_custkey", "c_nationkey", "c_mktsegment", "o_orderstatus"]
    found = [(a, i) for k, a in enumerate(order) for i in seq.relevant([dc(t) for t in FDS], order[:k], a)]
    return spark.createDataFrame(found, "attr string, dc int")


_HELD = ", ".join(f"({i}, '{a}')" for i, t in enumerate(FDS) for a in dc(t).attributes)


@query(f"WITH s AS ({ORACLES['attribute_sequence']}), held(dc, attr) AS (VALUES {_HELD}) SELECT arg_max(attr, pos) AS attr, CAST(dc AS INTEGER) AS dc FROM held JOIN s USING (attr) GROUP BY dc")
def relevant_constraints_of_sequence(spark, sf_dir):
    """Where each constraint is complete in the sequence that the table's domains give."""
    order = profile.attribute_sequence(order_wide(spark, sf_dir), [dc(t) for t in FDS], COLUMNS, {"c_acctbal": 100, "o_totalprice": 100})
    found = [(a, i) for k, a in enumerate(order) for i in seq.relevant([dc(t) for t in FDS], order[:k], a)]
    return spark.createDataFrame(found, "attr string, dc int")


@query(f"WITH {ORDER_WIDE_SQL} SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys FROM wide")
def key_uniqueness(spark, sf_dir):
    return profile.uniqueness(order_wide(spark, sf_dir), ["c_custkey"])


# --- marginals -----------------------------------------------------------------------------------

CATEGORIES = ["c_mktsegment", "n_name", "o_orderpriority", "o_orderstatus"]


def _halves(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return wide.filter("tid % 2 = 0"), wide.filter("tid % 2 = 1")


def _marginal_sql(k: int) -> str:
    parts = [f"SELECT '{','.join(s)}' AS attrs, [{', '.join(s)}] AS cell, count(*) AS n FROM wide GROUP BY ALL" for s in marginals.attribute_sets(CATEGORIES, k)]
    return f"WITH {ORDER_WIDE_SQL}, m AS ({' UNION ALL '.join(parts)}) SELECT attrs, array_to_string(cell, '|') AS cell, n FROM m"


def _marginal(k: int) -> None:
    def run(spark, sf_dir):
        found = marginals.marginals(order_wide(spark, sf_dir), marginals.attribute_sets(CATEGORIES, k))
        return found.select("attrs", F.array_join("cell", "|").alias("cell"), "n")

    run.__name__ = f"marginal_{k}way"
    query(_marginal_sql(k))(run)


for _k in (1, 2, 3):
    _marginal(_k)

_PREPARED_SQL = f"""{ORDER_WIDE_SQL},
b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(c_acctbal) AS alo, max(c_acctbal) AS ahi FROM wide WHERE tid % 2 = 0),
p AS (SELECT tid % 2 = 1 AS syn, lower(c_mktsegment) AS c_mktsegment, lower(o_orderpriority) AS o_orderpriority, lower(o_orderstatus) AS o_orderstatus,
  CAST(floor((least(greatest(o_totalprice, lo), hi) - lo) / ((hi - lo) / 16)) AS INTEGER) AS o_totalprice,
  CAST(floor((least(greatest(c_acctbal, alo), ahi) - alo) / ((ahi - alo) / 16)) AS INTEGER) AS c_acctbal FROM wide, b)"""
PREPARED = ["c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice", "c_acctbal"]


def _tvd_sql(k: int) -> str:
    parts = []
    for s in marginals.attribute_sets(PREPARED, k):
        parts.append(f"""SELECT '{','.join(s)}' AS attrs, sum(abs(t / nt - s / ns)) / 2 AS tvd FROM (
          SELECT count(*) FILTER (NOT syn) AS t, count(*) FILTER (syn) AS s FROM p GROUP BY {', '.join(s)}), (SELECT count(*) FILTER (NOT syn) AS nt, count(*) FILTER (syn) AS ns FROM p)""")
    return f"WITH {_PREPARED_SQL}, d AS ({' UNION ALL '.join(parts)})"


def _tvd(k: int) -> None:
    def run(spark, sf_dir):
        return marginals.marginal_report(*_halves(spark, sf_dir), PREPARED, k).withColumn("tvd", F.round("tvd", 9))

    run.__name__ = f"tvd_{k}way"
    query(_tvd_sql(k) + " SELECT attrs, round(tvd, 9) AS tvd FROM d")(run)


for _k in (1, 2, 3):
    _tvd(_k)


@query(" UNION ALL ".join(f"({_tvd_sql(k)} SELECT CAST({k} AS INTEGER) AS size, attrs, round(tvd, 9) AS tvd FROM d)" for k in (1, 2, 3)))
def tvd_lattice(spark, sf_dir):
    """Distances of all sets of one to three attributes, smaller ones rolled up from larger ones."""
    return marginals.lattice_report(*_halves(spark, sf_dir), PREPARED, 3).withColumn("tvd", F.round("tvd", 9))


@query(_tvd_sql(2) + " SELECT count(*) AS n_sets, round(avg(tvd), 9) AS avg_tvd FROM d")
def tvd_average(spark, sf_dir):
    return marginals.average(marginals.marginal_report(*_halves(spark, sf_dir), PREPARED, 2)).withColumn("avg_tvd", F.round("avg_tvd", 9))


def _bins(name: str, bins: int, kind: str) -> None:
    def run(spark, sf_dir):
        wide = order_wide(spark, sf_dir)
        lo, hi = transform.bounds(wide, ["o_totalprice"])["o_totalprice"]
        make = transform.cut if kind == "cut" else transform.binned
        return wide.groupBy(make(F.col("o_totalprice"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    at = f"(o_totalprice - lo) / ((hi - lo) / {bins})"
    expr = f"CAST(greatest(ceil({at}) - 1, 0) AS INTEGER)" if kind == "cut" else f"CAST(floor({at}) AS INTEGER)"
    run.__name__ = name
    query(f"WITH {ORDER_WIDE_SQL}, b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM wide) SELECT {expr} AS bin, count(*) AS n FROM wide, b GROUP BY 1")(run)


_bins("bins_16", 16, "floor")
_bins("bins_100", 100, "floor")
_bins("bins_50_right_closed", 50, "cut")


# --- noise and draws -----------------------------------------------------------------------------


@query(f"WITH {ORDER_WIDE_SQL} SELECT value, n, round(greatest(n + {rng.normal_sql(7, 'hist.n_name', 'value')} * 25.0, 0.0), 6) AS noisy FROM (SELECT n_name AS value, count(*) AS n FROM wide GROUP BY 1)")
def noisy_histogram_gauss(spark, sf_dir):
    return sampling.noisy_histogram(order_wide(spark, sf_dir), "n_name", 25.0, 7).withColumn("noisy", F.round("noisy", 6))


@query(f"WITH {ORDER_WIDE_SQL} SELECT value, n, round(greatest(n + {rng.laplace_sql(7, 'hist.n_name', 'value', 10.0)}, 0.0), 6) AS noisy FROM (SELECT n_name AS value, count(*) AS n FROM wide GROUP BY 1)")
def noisy_histogram_laplace(spark, sf_dir):
    return sampling.noisy_histogram(order_wide(spark, sf_dir), "n_name", 10.0, 7, "laplace").withColumn("noisy", F.round("noisy", 6))


@query(f"""WITH {ORDER_WIDE_SQL} SELECT CAST(value AS INTEGER) AS value, n, round(greatest(n + {rng.normal_sql(7, 'hist.n_regionkey', 'value')} * 400.0, 0.0), 6) AS noisy
FROM (SELECT d.value, count(tid) AS n FROM (SELECT unnest(range(9)) AS value) d LEFT JOIN wide ON n_regionkey = value GROUP BY 1)""")
def noisy_histogram_of_domain(spark, sf_dir):
    """Values of the public domain that don't occur are told as well."""
    return sampling.noisy_histogram(order_wide(spark, sf_dir), "n_regionkey", 400.0, 7, domain=range(9)).withColumn("noisy", F.round("noisy", 6))


@query()
def sparse_histogram(spark, sf_dir):
    """Customer, priority and status over a domain of 15 * 10 ** 12 cells."""
    wide = order_wide(spark, sf_dir)
    domains = {"c_custkey": range(10**12), "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_orderstatus": ["F", "O", "P"]}
    return sampling.sparse_private_histogram(wide, domains, 1.0, 6.0, 7)


_CDF = """h AS (SELECT {0} AS value, count(*) AS n FROM wide GROUP BY 1),
s AS (SELECT value, n / sum(n) OVER () AS p FROM h),
c AS (SELECT value, p, sum(p) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS hi FROM s),
d AS (SELECT value, coalesce(lag(hi) OVER (ORDER BY value), 0) AS lo, CASE WHEN lead(value) OVER (ORDER BY value) IS NULL THEN 2.0 ELSE hi END AS hi FROM c)"""


@query(f"WITH {ORDER_WIDE_SQL}, {_CDF.format('n_name')}, u AS (SELECT tid, {rng.uniform_sql(5, 'first.n_name', 'tid')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM wide))) AS tid)) SELECT tid, value AS n_name FROM u JOIN d ON u >= lo AND u < hi")
def first_attribute_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return sampling.first_attribute(spark, wide, "n_name", wide.count(), 0.0, 5).select("tid", "n_name")


@query(f"""WITH {ORDER_WIDE_SQL}, b AS (SELECT min(o_totalprice) AS blo, (max(o_totalprice) - min(o_totalprice)) / 100 AS width FROM wide),
w2 AS (SELECT CAST(floor((o_totalprice - blo) / width) AS INTEGER) AS bin FROM wide, b), {_CDF.format('bin').replace('FROM wide', 'FROM w2')},
u AS (SELECT tid, {rng.uniform_sql(5, 'price.bin', 'tid')} AS u, {rng.uniform_sql(5, 'price.in', 'tid')} AS v FROM wide)
SELECT tid, round(blo + width * (value + v), 4) AS price FROM u JOIN d ON u >= lo AND u < hi, b""")
def bin_uniform_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    lo, hi = transform.bounds(wide, ["o_totalprice"])["o_totalprice"]
    bins = wide.groupBy(transform.binned(F.col("o_totalprice"), lo, hi, 100).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("noisy"))
    return sampling.bin_uniform(wide.select("tid"), bins, "price", lo, (hi - lo) / 100, 5, "price").select("tid", F.round("price", 4).alias("price"))


@query(f"""WITH {ORDER_WIDE_SQL}, f AS (SELECT CASE WHEN o_totalprice > 150000 THEN 'one' ELSE 'zero' END AS a, CASE WHEN c_acctbal > 5000 THEN 'one' ELSE 'zero' END AS b, CASE WHEN o_orderstatus = 'P' THEN 'one' ELSE 'zero' END AS c FROM wide),
cells AS (SELECT x.v AS a, y.v AS b, z.v AS c FROM (VALUES ('zero'), ('one')) x(v), (VALUES ('zero'), ('one')) y(v), (VALUES ('zero'), ('one')) z(v))
SELECT cells.a, cells.b, cells.c, count(f.a) AS n FROM cells LEFT JOIN f USING (a, b, c) GROUP BY ALL""")
def joint_cells(spark, sf_dir):
    flag = lambda c: F.when(c, "one").otherwise("zero")
    wide = order_wide(spark, sf_dir).select(flag(F.col("o_totalprice") > 150000).alias("a"), flag(F.col("c_acctbal") > 5000).alias("b"), flag(F.col("o_orderstatus") == "P").alias("c"))
    return sampling.full_histogram(wide, ["a", "b", "c"], {c: ["zero", "one"] for c in "abc"})


@query(f"WITH {ORDER_WIDE_SQL} SELECT {rng.uniform_sql(0, 'split', 'tid')} < 0.9 AS train, count(*) AS n, CAST(sum(tid) AS BIGINT) AS tids FROM wide GROUP BY 1")
def keyed_split(spark, sf_dir):
    train, test = sampling.keyed_split(order_wide(spark, sf_dir), 0.9, 0)
    both = train.select(F.lit(True).alias("train"), "tid").unionByName(test.select(F.lit(False).alias("train"), "tid"))
    return both.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.sum("tid").alias("tids"))


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid FROM wide ORDER BY {rng.uniform_sql(3, 'subsample', 'tid')}, tid LIMIT 100")
def keyed_subsample(spark, sf_dir):
    return sampling.subsample(order_wide(spark, sf_dir).select("tid"), 100, 3)


@query(f"WITH {ORDER_WIDE_SQL}, r AS (SELECT row_number() OVER (ORDER BY tid) - 1 AS i, n_name FROM wide), u AS (SELECT tid, CAST(floor({rng.uniform_sql(3, 'upsample', 'tid')} * (SELECT count(*) FROM wide)) AS BIGINT) AS i FROM (SELECT unnest(range(500)) AS tid)) SELECT tid, n_name FROM u JOIN r USING (i)")
def keyed_upsample(spark, sf_dir):
    return sampling.upsample(order_wide(spark, sf_dir).select("tid", "n_name"), 500, 3)


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid FROM wide WHERE {rng.uniform_sql(3, 'batch.4', 'tid')} < 0.01")
def poisson_batch(spark, sf_dir):
    return sampling.poisson_batch(order_wide(spark, sf_dir).select("tid"), 0.01, 3, 4)


@query()
def mixture_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return sampling.gaussian_mixture(wide, "o_totalprice", wide.select("tid"), 5, 1).select("tid", "o_totalprice")


@query(f"""WITH {ORDER_WIDE_SQL}, pairs AS (SELECT c_mktsegment AS k, n_regionkey AS o, count(*) AS n FROM wide GROUP BY ALL),
best AS (SELECT k, o, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, o DESC) AS r FROM pairs) WHERE r = 1),
cdf AS (SELECT k, o, sum(n) OVER w / sum(n) OVER (PARTITION BY o) AS hi, sum(n) OVER w / sum(n) OVER (PARTITION BY o) - n / sum(n) OVER (PARTITION BY o) AS lo FROM best WINDOW w AS (PARTITION BY o ORDER BY k ROWS UNBOUNDED PRECEDING)),
u AS (SELECT tid, n_regionkey, {rng.uniform_sql(2, 'owner.c_mktsegment', 'tid')} AS u FROM wide)
SELECT tid, n_regionkey, k AS c_mktsegment FROM u LEFT JOIN cdf ON n_regionkey = o AND u >= lo AND u < hi""")
def owner_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return sampling.owner_draw(wide.select("tid", "n_regionkey"), wide, "c_mktsegment", "n_regionkey", 2).select("tid", "n_regionkey", "c_mktsegment")


# --- transforms ----------------------------------------------------------------------------------


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, o_orderstatus || '_' || o_orderpriority AS combo FROM wide")
def concat_attributes(spark, sf_dir):
    return transform.concatenated(order_wide(spark, sf_dir).select("tid", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "combo")


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, o_orderstatus, o_orderpriority FROM wide")
def concat_then_split(spark, sf_dir):
    joined = concat_attributes(spark, sf_dir)
    return transform.split_again(joined, "combo", ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {ORDER_WIDE_SQL}, n AS (SELECT n_name, c_custkey, count(*) AS n FROM wide GROUP BY ALL)
SELECT tid, n_name, CASE WHEN n < 10 THEN n_name || '_ocust' ELSE CAST(c_custkey AS VARCHAR) END AS c_custkey FROM wide JOIN n USING (n_name, c_custkey)""")
def rare_generalised(spark, sf_dir):
    return transform.generalised(order_wide(spark, sf_dir).select("tid", "n_name", "c_custkey"), "n_name", {"c_custkey": "ocust"}, "c_custkey", 10)


@query(f"""WITH {ORDER_WIDE_SQL}, n AS (SELECT n_name, c_custkey, count(*) AS n FROM wide GROUP BY ALL),
g AS (SELECT tid, n_name, CASE WHEN n < 10 THEN n_name || '_ocust' ELSE CAST(c_custkey AS VARCHAR) END AS c FROM wide JOIN n USING (n_name, c_custkey)),
v AS (SELECT n_name, v, row_number() OVER (PARTITION BY n_name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY n_name) AS k FROM (SELECT DISTINCT n_name, CAST(c_custkey AS VARCHAR) AS v FROM wide)),
a AS (SELECT g.*, CASE WHEN c = n_name || '_ocust' THEN CAST(floor({rng.uniform_sql(0, 'restore.c_custkey', 'tid')} * (SELECT max(k) FROM v WHERE v.n_name = g.n_name)) AS BIGINT) END AS i FROM g)
SELECT tid, a.n_name, coalesce(v.v, c) AS c_custkey FROM a LEFT JOIN v ON a.n_name = v.n_name AND a.i = v.i""")
def rare_restored(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return transform.restored(rare_generalised(spark, sf_dir), wide, "n_name", "c_custkey", "ocust").select("tid", "n_name", "c_custkey")


@query(f"WITH {ORDER_WIDE_SQL}, b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM wide) SELECT tid, round(least(greatest(o_totalprice, 50000.0), 250000.0), 6) AS clipped, round((o_totalprice - lo) / (hi - lo), 9) AS scaled FROM wide, b")
def clip_and_scale(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    lo, hi = transform.bounds(wide, ["o_totalprice"])["o_totalprice"]
    x = F.col("o_totalprice")
    return wide.select("tid", F.round(transform.clipped(x, 50000.0, 250000.0), 6).alias("clipped"), F.round(transform.scaled(x, lo, hi), 9).alias("scaled"))


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, lower(n_name) AS n_name, CAST(o_totalprice >= 100000 AND o_totalprice < 200000 AS INTEGER) AS mid, CAST(lower(c_mktsegment) IN ('building', 'machinery') AS INTEGER) AS seg FROM wide")
def lower_and_binarise(spark, sf_dir):
    wide = transform.lower_cased(order_wide(spark, sf_dir), ["n_name", "c_mktsegment"])
    return wide.select("tid", "n_name", transform.positive(F.col("o_totalprice"), None, 100000, 200000).alias("mid"), transform.positive(F.col("c_mktsegment"), ["building", "machinery"]).alias("seg"))


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM wide")
def one_hot_columns(spark, sf_dir):
    return transform.one_hot(order_wide(spark, sf_dir).select("tid", "o_orderstatus"), "o_orderstatus", list("FOP")).drop("o_orderstatus")


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, n_name, c_mktsegment, false AS is_synthetic FROM wide WHERE tid % 2 = 0 UNION ALL SELECT tid, n_name, NULL, true FROM wide WHERE tid % 2 = 1")
def training_rows(spark, sf_dir):
    true, syn = _halves(spark, sf_dir)
    return transform.training_rows(true, syn, ["tid", "n_name"], "c_mktsegment").select("tid", "n_name", "c_mktsegment", "is_synthetic")


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, n_name, o_totalprice FROM wide")
def paste_by_tid(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return transform.pasted(wide.select("tid", "n_name"), wide.select("tid", "o_totalprice"))


@query(f"WITH {ORDER_WIDE_SQL} SELECT is_synthetic, count(*) AS n, count(DISTINCT n_name) AS names FROM (SELECT *, tid % 2 = 1 AS is_synthetic FROM wide) GROUP BY 1")
def stack_and_split(spark, sf_dir):
    parts = transform.unstacked(transform.stacked(*_halves(spark, sf_dir)))
    sides = [p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_name").alias("names")).withColumn("is_synthetic", F.lit(bool(i))) for i, p in enumerate(parts)]
    return sides[0].unionByName(sides[1]).select("is_synthetic", "n", "names")


@query("SELECT c_custkey, try_cast(c_name AS DOUBLE) AS as_number, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS has_text FROM customer")
def cast_synthetic(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    like = c.select("c_custkey", F.lit(1.0).alias("c_name"), F.col("c_acctbal").cast("string").alias("c_acctbal")).limit(0)
    return transform.cast_like(c.select("c_acctbal", "c_name", "c_custkey"), like).select("c_custkey", F.col("c_name").alias("as_number"), F.col("c_acctbal").isNotNull().alias("has_text"))


# --- dependencies --------------------------------------------------------------------------------


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, first_value(o_orderstatus) OVER (PARTITION BY c_custkey ORDER BY tid) AS first FROM wide")
def first_of_key(spark, sf_dir):
    return dependency.first_of_key(order_wide(spark, sf_dir), ["c_custkey"], "o_orderstatus", name="first").select("tid", "first")


@query(f"WITH {ORDER_WIDE_SQL} SELECT tid, first_value(o_orderstatus) OVER (PARTITION BY c_custkey, o_orderpriority ORDER BY tid) AS first FROM wide")
def running_first_of_key(spark, sf_dir):
    return dependency.running_first(order_wide(spark, sf_dir), ["c_custkey", "o_orderpriority"], "o_orderstatus").select("tid", "first")


@query(f"""WITH {ORDER_WIDE_SQL}, e AS (SELECT t1.tid, t2.o_totalprice AS x, t2.c_custkey AS k, t2.tid AS t, t1.o_totalprice AS x1, t2.o_totalprice * 2 AS v FROM wide t1 JOIN wide t2 ON t1.c_custkey = t2.c_custkey AND t2.tid < t1.tid),
lo AS (SELECT tid, arg_max(v, x) AS below FROM e WHERE x <= x1 GROUP BY tid), hi AS (SELECT tid, arg_min(v, x) AS above FROM e WHERE x >= x1 GROUP BY tid)
SELECT wide.tid, round(below, 4) AS below, round(above, 4) AS above FROM wide LEFT JOIN lo USING (tid) LEFT JOIN hi USING (tid)""")
def nearest_earlier(spark, sf_dir):
    wide = order_wide(spark, sf_dir).select("tid", "c_custkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("v"))
    found = dependency.nearest_earlier(wide, ["c_custkey"], "o_totalprice", "v")
    return found.select("tid", F.round("below", 4).alias("below"), F.round("above", 4).alias("above"))


@query(f"""WITH {ORDER_WIDE_SQL}, n AS (SELECT c_custkey, o_orderstatus, count(*) AS n FROM wide GROUP BY ALL), b AS (SELECT c_custkey, o_orderstatus AS best FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, o_orderstatus) AS r FROM n) WHERE r = 1)
SELECT tid, c_custkey, best AS o_orderstatus FROM wide JOIN b USING (c_custkey)""")
def dependency_repaired(spark, sf_dir):
    return dependency.repaired(order_wide(spark, sf_dir).select("tid", "c_custkey", "o_orderstatus"), ["c_custkey"], "o_orderstatus")


@query()
def repair_order_constraint(spark, sf_dir):
    """Cells changed so that no two orders of a customer, and no order by itself, violate; the test holds that nothing is violated afterwards."""
    wide = order_wide(spark, sf_dir).select("tid", "c_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return repair.repair(wide, [dc(EQ_ORDER), dc(ONE_TUPLE)])[1]


def _monotone(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    rows = wide.select("tid", "n_name", "o_totalprice", rng.uniform(9, "rate", F.col("tid")).alias("drawn_"), rng.uniform(9, "again", F.col("tid")).alias("again_"))
    return dependency.monotone_fill(rows, ["n_name"], "o_totalprice", "drawn_", "again_", 0.0, 1.0, "rate").select("tid", "n_name", "o_totalprice", "rate")


@query()
def monotone_fill(spark, sf_dir):
    return _monotone(spark, sf_dir)


@query("SELECT 0 AS n_vio")
def monotone_fill_holds(spark, sf_dir):
    c = dc("t1&t2&EQ(t1.n_name,t2.n_name)&GT(t1.o_totalprice,t2.o_totalprice)&LT(t1.rate,t2.rate)")
    return violations.count_violations(_monotone(spark, sf_dir), c, mode="ordered").select(F.col("n_vio").cast("int"))


# --- conditional models and synthesis ------------------------------------------------------------

_DRAW_SQL = """c AS (SELECT {0}, val, sum(p) OVER (PARTITION BY {0} ORDER BY val ROWS UNBOUNDED PRECEDING) AS hi FROM p),
d AS (SELECT {0}, val, coalesce(lag(hi) OVER w, 0) AS lo, CASE WHEN lead(val) OVER w IS NULL THEN 2.0 ELSE hi END AS hi FROM c WINDOW w AS (PARTITION BY {0} ORDER BY val))"""
_COND_SQL = f"WITH {ORDER_WIDE_SQL}, f AS (SELECT n_name, o_orderpriority AS val, count(*) AS n FROM wide GROUP BY ALL), p AS (SELECT n_name, val, n, n / sum(n) OVER (PARTITION BY n_name) AS p FROM f)"


@query(_COND_SQL + " SELECT n_name, val, n, round(p, 9) AS p FROM p")
def conditional_histogram(spark, sf_dir):
    return model.ConditionalHistogram("o_orderpriority", ("n_name",)).fit(order_wide(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(_COND_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY p DESC, val DESC) AS r FROM p) SELECT n_name, string_agg(val, '|' ORDER BY r) AS vals FROM r WHERE r <= 3 GROUP BY n_name")
def candidates_topk(spark, sf_dir):
    m = model.ConditionalHistogram("o_orderpriority", ("n_name",))
    found = m.candidates(m.fit(order_wide(spark, sf_dir)), 3)
    return found.select("n_name", F.array_join(F.col("candidates.val"), "|").alias("vals"))


@query(_COND_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY p DESC, val DESC) AS r FROM p) SELECT n_name, max(val) FILTER (r = 1) AS best, string_agg(val, '|' ORDER BY r) FILTER (r IN (3, 4)) AS page FROM r GROUP BY n_name")
def candidate_pages(spark, sf_dir):
    m = model.ConditionalHistogram("o_orderpriority", ("n_name",))
    found = m.candidates(m.fit(order_wide(spark, sf_dir)))
    return found.select("n_name", model.best(F.col("candidates")).alias("best"), F.array_join(model.page(F.col("candidates"), 1, 2)["val"], "|").alias("page"))


@query(_COND_SQL + ", q AS (SELECT n_name, val, p * exp(-(0.001 * n + 0.0005 * length(val))) AS w FROM p) SELECT n_name, val, round(w / sum(w) OVER (PARTITION BY n_name), 9) AS p FROM q")
def reweighted_candidates(spark, sf_dir):
    from pyspark.sql import Window

    fitted = model.ConditionalHistogram("o_orderpriority", ("n_name",)).fit(order_wide(spark, sf_dir))
    w = probability.reweighted(F.col("p"), [0.001, 0.0005], [F.col("n"), F.length("val")])
    return fitted.withColumn("w", w).select("n_name", "val", F.round(probability.normalised(F.col("w"), Window.partitionBy("n_name")), 9).alias("p"))


@query(_COND_SQL + f", {_DRAW_SQL.format('n_name')}, u AS (SELECT tid, n_name, {rng.uniform_sql(8, 'fill.o_orderpriority.pick', 'tid')} AS u FROM wide) SELECT tid, u.n_name, val AS o_orderpriority FROM u JOIN d ON u.n_name = d.n_name AND u >= lo AND u < hi")
def conditional_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    return constrained.fill_attribute(wide.select("tid", "n_name"), wide, "o_orderpriority", [], [], constrained.Settings(seed=8), parents=("n_name",))


@query(_COND_SQL + ", b AS (SELECT n_name, max_by(val, (p, val)) AS best FROM p GROUP BY 1) SELECT tid, wide.n_name, best AS o_orderpriority FROM wide JOIN b USING (n_name)")
def hard_dependency_best(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    rule = dc("t1&t2&EQ(t1.n_name,t2.n_name)&IQ(t1.o_orderpriority,t2.o_orderpriority)")
    return constrained.fill_attribute(wide.select("tid", "n_name"), wide, "o_orderpriority", [rule], [1000.0], constrained.Settings(seed=8))


@query(f"""WITH {ORDER_WIDE_SQL}, m AS (SELECT c_mktsegment, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM wide GROUP BY 1), b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM wide)
SELECT tid, c_mktsegment, round(least(greatest(mu + sd * {rng.normal_sql(8, 'fill.o_totalprice', 'tid')}, lo), hi), 2) AS o_totalprice FROM wide JOIN m USING (c_mktsegment), b""")
def conditional_normal_draw(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    made = constrained.fill_attribute(wide.select("tid", "c_mktsegment"), wide, "o_totalprice", [], [], constrained.Settings(seed=8), True, ("c_mktsegment",))
    return made.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(f"WITH {ORDER_WIDE_SQL} SELECT c_mktsegment, round(avg(o_totalprice), 4) AS mu, round(stddev_pop(o_totalprice), 4) AS sigma, count(*) AS n FROM wide GROUP BY 1")
def conditional_normal(spark, sf_dir):
    found = model.ConditionalNormal("o_totalprice", ("c_mktsegment",)).fit(order_wide(spark, sf_dir))
    return found.withColumns({"mu": F.round("mu", 4), "sigma": F.round("sigma", 4)})


@query(f"WITH {ORDER_WIDE_SQL}, m AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM wide) SELECT tid, round(exp(-0.5 * ((o_totalprice - mu) / sd) * ((o_totalprice - mu) / sd)) / (sd * sqrt(2 * pi())) * 1e6, 6) AS density FROM wide, m")
def normal_density(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    m = wide.agg(F.avg("o_totalprice").alias("mu"), F.stddev_pop("o_totalprice").alias("sd"))
    return wide.join(F.broadcast(m)).select("tid", F.round(probability.normal_pdf(F.col("o_totalprice"), F.col("mu"), F.col("sd")) * 1e6, 6).alias("density"))


SYNTH = ["c_mktsegment", "n_name", "n_regionkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
SYNTH_DCS = [FDS[3], "t1&t2&EQ(t1.n_name,t2.n_name)&EQ(t1.c_mktsegment,t2.c_mktsegment)&IQ(t1.o_orderstatus,t2.o_orderstatus)"]


def _synthetic(spark, sf_dir, **settings):
    weights = [1000.0, 0.5]
    return constrained.synthesize(order_wide(spark, sf_dir), [dc(t) for t in SYNTH_DCS], weights, SYNTH, settings=constrained.Settings(seed=1, bins={"o_totalprice": 100}, **settings))


@query()
def synthesize_default(spark, sf_dir):
    return _synthetic(spark, sf_dir)


@query()
def synthesize_accept_reject(spark, sf_dir):
    return _synthetic(spark, sf_dir, sampler="ar")


@query()
def synthesize_mcmc(spark, sf_dir):
    return _synthetic(spark, sf_dir, sampler="mcmc")


@query()
def synthesize_private(spark, sf_dir):
    settings = constrained.Settings(seed=1, bins={"o_totalprice": 100}, bounds={"o_totalprice": (0.0, 600000.0)})
    return constrained.synthesize_private(order_wide(spark, sf_dir), [dc(t) for t in SYNTH_DCS], [1000.0, 0.5], SYNTH, 1.0, settings=settings)[0]


@query()
def synthesize_logistic(spark, sf_dir):
    """Attributes without dependencies from a model of all earlier ones."""
    return _synthetic(spark, sf_dir, model="logistic", model_steps=10)


@query()
def synthesize_continued(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    start = sampling.first_attribute(spark, wide, "n_name", wide.count(), 0.0, 4).select("tid", "n_name")
    return constrained.synthesize(wide, [dc(SYNTH_DCS[0])], [1000.0], ["n_name", "n_regionkey", "o_orderpriority"], start=start)


@query("SELECT 0 AS n_vio")
def synthesize_keeps_hard_dependency(spark, sf_dir):
    return violations.count_violations(_synthetic(spark, sf_dir), dc(FDS[3])).select(F.col("n_vio").cast("int"))


@query(f"""WITH {ORDER_WIDE_SQL}, {_CDF.format('c_custkey')}, u AS (SELECT tid, {rng.uniform_sql(4, 'first.c_custkey', 'tid')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM wide))) AS tid)),
k AS (SELECT tid, value AS c_custkey FROM u JOIN d ON u >= lo AND u < hi) SELECT tid, k.c_custkey, customer.c_nationkey FROM k JOIN customer USING (c_custkey)""")
def hard_dependency_rows(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    start = sampling.first_attribute(spark, wide, "c_custkey", wide.count(), 0.0, 4).select("tid", "c_custkey")
    return constrained.hard_dependency(start, wide, "c_nationkey", ["c_custkey"], constrained.Settings()).select("tid", "c_custkey", "c_nationkey")


@query("SELECT 0 AS n_vio")
def hard_dependency_fill(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    start = sampling.first_attribute(spark, wide, "c_custkey", wide.count(), 0.0, 4).select("tid", "c_custkey")
    made = constrained.hard_dependency(start, wide, "c_nationkey", ["c_custkey"], constrained.Settings())
    return violations.count_violations(made, dc(FDS[0])).select(F.col("n_vio").cast("int"))


# --- weights, accountant, reports ----------------------------------------------------------------

_RATES = ", ".join(f"({s}, {learning.learning_rate(s, 20, 1e-4)!r}::DOUBLE)" for s in range(20))


@query(f"""WITH {ORDER_WIDE_SQL}, v AS (
  SELECT t1.tid, 0 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(TWO_IQ).sql()} GROUP BY t1.tid UNION ALL
  SELECT t1.tid, 1 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(EQ_ORDER).sql()} GROUP BY t1.tid),
r(step, lr) AS (VALUES {_RATES}),
s AS (SELECT dc, sum(lr * n) AS weight FROM v, r WHERE {rng.uniform_sql(2, 'batch', "step || '|' || tid")} < 100 / (SELECT count(*) FROM wide)::DOUBLE GROUP BY dc)
SELECT CAST(dc AS INTEGER) AS dc, round(weight, 9) AS weight FROM s""")
def weights_closed_form(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    matrix = violations.violation_matrix(wide, [dc(TWO_IQ), dc(EQ_ORDER)])
    return learning.closed_form(matrix, 20, 100, wide.count(), 1e-4, 2).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {ORDER_WIDE_SQL}, v AS (
  SELECT t1.tid, 0 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(TWO_IQ).sql()} GROUP BY t1.tid UNION ALL
  SELECT t1.tid, 1 AS dc, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(EQ_ORDER).sql()} GROUP BY t1.tid),
c AS (SELECT count(*) AS n FROM wide), ids AS (SELECT tid, row_number() OVER (ORDER BY tid) - 1 AS rank FROM wide),
gaps AS (SELECT step, j, floor(ln({rng.uniform_sql(2, 'skip', "step || '|' || j")}) / ln(1 - 128 / n::DOUBLE)) + 1 AS gap FROM (SELECT unnest(range(891)) AS step), (SELECT unnest(range(400)) AS j), c),
chosen AS (SELECT step, sum(gap) OVER (PARTITION BY step ORDER BY j ROWS UNBOUNDED PRECEDING) - 1 AS rank FROM gaps),
factors AS (SELECT tid, sum(1e-4::DOUBLE / 2 * (1 + cos(pi() * step / 891::DOUBLE))) AS lr FROM chosen JOIN ids USING (rank) GROUP BY tid)
SELECT CAST(dc AS INTEGER) AS dc, round(sum(lr * n), 9) AS weight FROM v JOIN factors USING (tid) GROUP BY dc""")
def weights_skip_sampling(spark, sf_dir):
    """891 steps of batches of 128 rows, as many as a published weight file tells."""
    wide = order_wide(spark, sf_dir)
    matrix = checkpoint(violations.violation_matrix(wide, [dc(TWO_IQ), dc(EQ_ORDER)]))
    return learning.closed_form_skipping(matrix, 891, 128, wide.count(), 1e-4, 2).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {ORDER_WIDE_SQL}, v AS (
  SELECT 0 AS dc, count(*) AS v FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(TWO_IQ).sql()} UNION ALL
  SELECT 1 AS dc, count(*) AS v FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(EQ_ORDER).sql()})
SELECT CAST(dc AS INTEGER) AS dc, round(greatest(ln(((SELECT count(*) FROM wide) + 1.0::DOUBLE) / (v + 1.0::DOUBLE)), 0), 9) AS weight FROM v""")
def weights_likelihood(spark, sf_dir):
    matrix = violations.violation_matrix(order_wide(spark, sf_dir), [dc(TWO_IQ), dc(EQ_ORDER)])
    return learning.likelihood(matrix).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {ORDER_WIDE_SQL}, v AS (SELECT t1.tid, count(*) AS n FROM wide t1 JOIN wide t2 ON t1.tid <> t2.tid AND {dc(TWO_IQ).sql()} GROUP BY t1.tid)
SELECT wide.tid, CAST(0 AS INTEGER) AS dc, round(greatest(coalesce(n, 0) + 3.0 * {rng.normal_sql(6, 'matrix', "wide.tid || '|0'")}, 0.0), 6) AS n FROM wide LEFT JOIN v USING (tid)""")
def noisy_violation_matrix(spark, sf_dir):
    matrix = violations.violation_matrix(order_wide(spark, sf_dir), [dc(TWO_IQ)])
    return learning.noisy_matrix(matrix, 3.0, 6).withColumn("n", F.round("n", 6))


#: (name, sampling rate, noise multiplier, repetitions) of the steps of a run, and its delta.
ACCOUNTS = {
    "adult": ([(23 / 32561, 1.1, 1600 * 14)], 1e-6),
    "adult_total": ([(23 / 32561, 1.1, 1600 * 14), (1.0, privacy.gaussian_sigma(0.1, 1e-6) / 2**0.5, 1)], 1e-6),
    "br2000": ([(29 / 38000, 1.1, 1500 * 13)], 1e-6),
    "gauss": ([(1.0, 4.0, 1)], 1e-5),
}
_STEPS = ", ".join(f"('{name}', {q!r}::DOUBLE, {z!r}::DOUBLE, {n}, {delta!r}::DOUBLE)" for name, (steps, delta) in ACCOUNTS.items() for q, z, n in steps)


_ACCOUNT = f"""orders_ AS (SELECT unnest(range(2, 65) || [{', '.join(map(str, privacy.ORDERS[63:]))}]) AS a),
terms AS (SELECT run, q, z, n, delta, a, lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + k * ln(q) + (a - k) * ln(1 - q) + (k * k - k) / (2 * z * z) AS t
          FROM steps, orders_, LATERAL (SELECT unnest(range(a + 1)) AS k) WHERE q < 1),
sampled AS (SELECT run, n, delta, a, greatest(0, (max(t) + ln(sum(exp(t - m)))) / (a - 1)) AS rdp FROM (SELECT *, max(t) OVER (PARTITION BY run, q, z, a) AS m FROM terms) GROUP BY run, q, z, n, delta, a),
whole AS (SELECT run, n, delta, a, a / (2 * z * z) AS rdp FROM steps, orders_ WHERE q = 1),
total AS (SELECT run, delta, a, sum(n * rdp) AS rdp FROM (FROM sampled UNION ALL FROM whole) GROUP BY ALL)
SELECT run, round(min(rdp + ln(1 - 1 / a) - (ln(delta) + ln(a)) / (a - 1)), 6) AS epsilon FROM total GROUP BY run"""


@query(f"WITH steps(run, q, z, n, delta) AS (VALUES {_STEPS}), {_ACCOUNT}")
def privacy_accountant(spark, sf_dir):
    rows = [
        ("adult", privacy.training_epsilon(32561, 23, 1.1, 1600, 15, 1e-6)),
        ("adult_total", privacy.total_epsilon(32561, 23, 1.1, 1600, 15, 1e-6, [privacy.gaussian_sigma(0.1, 1e-6) / 2**0.5])),
        ("br2000", privacy.training_epsilon(38000, 29, 1.1, 1500, 14, 1e-6)),
        ("gauss", privacy.composed_epsilon([(1.0, 4.0, 1)], 1e-5)),
    ]
    return spark.createDataFrame([(name, round(epsilon, 6)) for name, epsilon in rows], "run string, epsilon double")


@query(f"""WITH c AS (SELECT count(*)::DOUBLE AS rows, 1 / power(10.0::DOUBLE, length(CAST(count(*) AS VARCHAR)) + 1) AS delta FROM orders),
steps AS (SELECT 'training' AS run, 128 / rows AS q, 1.1::DOUBLE AS z, 12800 AS n, delta FROM c UNION ALL SELECT 'total', 128 / rows, 1.1, 12800, delta FROM c UNION ALL SELECT 'total', 1, 8, 1, delta FROM c), {_ACCOUNT}""")
def privacy_of_orders(spark, sf_dir):
    """Epsilon of training eight models on the orders, without and with one release of counts: sampling rate and delta come from the table."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    delta = privacy.delta_for(n)
    rows = [("training", privacy.training_epsilon(n, 128, 1.1, 1600, 9, delta)), ("total", privacy.total_epsilon(n, 128, 1.1, 1600, 9, delta, [8.0]))]
    return spark.createDataFrame([(name, round(e, 6)) for name, e in rows], "run string, epsilon double")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), d AS (SELECT n, 1 / power(10.0::DOUBLE, length(CAST(n AS VARCHAR)) + 1) AS delta FROM n)
SELECT round(delta * 1e6, 9) AS delta_millionths, round(sqrt(2 * 2 * ln(1.25 / delta)) / 0.4, 9) AS sigma, round(sqrt(2 * (n * n - n)) * sqrt(2 * ln(1.25 / delta)) / 0.2, 4) AS matrix_sigma FROM d""")
def noise_scales(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    delta = privacy.delta_for(n)
    row = (round(delta * 1e6, 9), round(privacy.gaussian_sigma(0.4, delta), 9), round(learning.matrix_sigma(n, 2, 0.2, delta), 4))
    return spark.createDataFrame([row], "delta_millionths double, sigma double, matrix_sigma double")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_there_and_back(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = f"{shared_folder(spark)}/customer-{uuid.uuid4().hex}"
    save_table(customers, path, "csv", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return read_csv(spark, path, customers.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").schema)


@query(f"""{_tvd_sql(1)}, d2 AS ({_tvd_sql(2).split('d AS (', 1)[1][:-1]}), syn AS (SELECT * FROM wide WHERE tid % 2 = 1)
SELECT 'marginal_1' AS report, round(avg(tvd), 9) AS value FROM d UNION ALL SELECT 'marginal_2', round(avg(tvd), 9) FROM d2
""" + "".join(f" UNION ALL SELECT 'violations {i}', CAST(n AS DOUBLE) FROM ({_pairs_sql(t, table='syn')})" for i, t in enumerate([BROKEN, EQ_ORDER, ONE_TUPLE])))
def evaluation_reports(spark, sf_dir):
    true, syn = _halves(spark, sf_dir)
    rules = [dc(t) for t in (BROKEN, EQ_ORDER, ONE_TUPLE)]
    found = evaluate.evaluate(true, syn, rules, PREPARED)
    told = [found[f"marginal_{k}_average"].select(F.lit(f"marginal_{k}").alias("report"), F.round("avg_tvd", 9).alias("value")) for k in (1, 2)]
    number = F.create_map(*[F.lit(x) for i, c in enumerate(rules) for x in (str(c), f"violations {i}")])
    return told[0].unionByName(told[1]).unionByName(found["violations"].select(number[F.col("dc")].alias("report"), F.col("n_vio").cast("double").alias("value")))


@query(f"""WITH {ORDER_WIDE_SQL}, p AS (SELECT CAST(o_totalprice > 150000 AS INTEGER) AS l, CAST(c_acctbal > 4500 AS INTEGER) AS q FROM wide),
c AS (SELECT count(*) FILTER (l = 1 AND q = 1) AS tp, count(*) FILTER (l = 0 AND q = 1) AS fp, count(*) FILTER (l = 1 AND q = 0) AS fn, count(*) FILTER (l = 0 AND q = 0) AS tn FROM p)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM c""")
def classifier_metrics(spark, sf_dir):
    p = order_wide(spark, sf_dir).select((F.col("o_totalprice") > 150000).cast("int").alias("l"), (F.col("c_acctbal") > 4500).cast("int").alias("q"))
    found = evaluate.confusion(p, "l", "q")
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query()
def classifier_report(spark, sf_dir):
    true, syn = _halves(spark, sf_dir)
    columns = ["tid", "c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice", "c_acctbal"]
    target = evaluate.Target("o_orderstatus", ("o",))
    return evaluate.classifier_report(true.select(*columns), syn.select(*columns), [target], ("logistic", "tree", "bayes"))


@query()
def classifier_report_ensembles(spark, sf_dir):
    true, syn = _halves(spark, sf_dir)
    columns = ["tid", "c_mktsegment", "o_orderstatus", "o_totalprice", "c_acctbal"]
    models = [m for m in evaluate.MODELS if m not in ("logistic", "tree", "bayes")]
    return evaluate.classifier_report(true.select(*columns), syn.select(*columns), [evaluate.Target("o_totalprice", None, 0, 150000)], models)


# --- whole runs ----------------------------------------------------------------------------------


@query()
def flow_keyed(spark, sf_dir):
    columns = ["c_custkey", "c_nationkey", "c_mktsegment", "n_name", "o_orderpriority", "o_orderstatus", "c_acctbal", "o_totalprice"]
    settings = constrained.Settings(seed=3, sigma_first=2.0)
    return flows.keyed_flow(order_wide(spark, sf_dir), [dc(t) for t in FDS[:3]], [1000.0] * 3, columns, "c_custkey", ["c_mktsegment", "c_nationkey", "n_name"], NUMBERS, {"c_acctbal": 100, "o_totalprice": 100}, settings)


@query("SELECT * FROM (VALUES (0), (0), (0)) t(n_vio)")
def flow_keyed_keeps_dependencies(spark, sf_dir):
    made = flow_keyed(spark, sf_dir).select("tid", "c_custkey", "c_nationkey", "c_mktsegment", "n_name")
    return violations.violation_report(made, [dc(t) for t in FDS[:3]]).select(F.col("n_vio").cast("int"))


@query()
def flow_grouped(spark, sf_dir):
    columns = ["n_name", "n_regionkey", "o_orderstatus", "o_orderpriority"]
    return flows.grouped_flow(order_wide(spark, sf_dir), [dc(FDS[3])], [1000.0], columns, {"status_priority": ["o_orderstatus", "o_orderpriority"]}, constrained.Settings(seed=3))


@query()
def flow_binary(spark, sf_dir):
    flag = lambda c: F.when(c, "one").otherwise("zero")
    wide = order_wide(spark, sf_dir).select("tid", "n_name", flag(F.col("o_totalprice") > 150000).alias("a"), flag(F.col("c_acctbal") > 5000).alias("b"), "o_orderstatus")
    c = dc("t1&t2&EQ(t1.n_name,t2.n_name)&IQ(t1.a,t2.a)&EQ(t1.o_orderstatus,t2.o_orderstatus)")
    return flows.binary_flow(wide, [c], ["a", "b", "n_name", "o_orderstatus"], ["a", "b"], constrained.Settings(seed=3, sigma_first=1.0))[0]


@query("SELECT * FROM (VALUES (0), (0)) t(n_vio)")
def flow_monotone_keeps_order(spark, sf_dir):
    wide = order_wide(spark, sf_dir)
    settings = constrained.Settings(seed=3)
    start = sampling.first_attribute(spark, wide, "n_name", wide.count(), 0.0, 3).select("tid", "n_name")
    start = constrained.fill_attribute(start, wide, "c_mktsegment", [], [], settings)
    made = flows.monotone_flow(start, wide, "n_name", "o_totalprice", "c_acctbal", 50, settings)
    rules = ["t1&t2&EQ(t1.n_name,t2.n_name)&GT(t1.o_totalprice,t2.o_totalprice)&LT(t1.c_acctbal,t2.c_acctbal)", "t1&t2&EQ(t1.n_name,t2.n_name)&EQ(t1.o_totalprice,t2.o_totalprice)&IQ(t1.c_acctbal,t2.c_acctbal)"]
    return violations.violation_report(made, [dc(t) for t in rules], mode="ordered").select(F.col("n_vio").cast("int"))
