"""The registered queries of the engine's own operators, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions import zset
from brooklet.operators import route
from brooklet.operators.aggregate import Aggregate, aggregate, count_from_groups, group_counts, plan_from_counts
from brooklet.operators.compile import where
from brooklet.operators.params import collect, substitute
from brooklet.operators.predicate import And, In, Or, Predicate, from_json, tables, validate
from brooklet.operators.subset import query_subset
from brooklet.operators.where_parser import parse
from brooklet.plans.parts import PARTS
from brooklet.plans.replay import HIGH, PRIORITIES, replay
from brooklet.schema import TableSchema

Query = Callable[[SparkSession, str], DataFrame]

#: Primary keys of the test tables; lineitem has none that is unique, and is only filtered and summed.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": ["l_orderkey", "l_linenumber"], "events": "event_id", "documents": "doc_id", "labels": "doc_id",
}


@dataclass
class Source:
    """The tables of one folder, with their schemas."""

    spark: SparkSession
    sf_dir: str

    def df(self, table: str) -> DataFrame:
        if table == "sparse_events":  # events whose type is NULL in every fifth row
            return self.df("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("et"))
        if table == "sparse_orders":
            return self.df("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"))
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def schema(self, table: str) -> TableSchema:
        return TableSchema.from_df(table, self.df(table), {"sparse_events": "event_id", "sparse_orders": "o_orderkey"}.get(table) or KEYS[table])

    def predicate(self, table: str, text: str | Predicate | None) -> tuple[Predicate | None, dict[str, DataFrame]]:
        p = parse(text) if isinstance(text, str) else text
        names = {table} | tables(p)
        return validate(p, table, {t: self.schema(t) for t in names}), {t: self.df(t) for t in tables(p)}


def _filter(table: str, text: str | Predicate | None, columns: list[str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Source(spark, sf_dir)
        p, inner = s.predicate(table, text)
        return where(s.df(table), p, inner).select(*s.schema(table).projected(columns))

    return run


def _aggregate(table: str, fn: str, col: str | None, text: str | None, digits: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Source(spark, sf_dir)
        out = aggregate(s.df(table), s.schema(table), Aggregate(fn, col), s.predicate(table, text)[0])
        return out if digits is None else out.withColumn("value", F.round("value", digits))

    return run


def _subset(table: str, text: str | None = None, columns: list[str] | None = None, **page) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Source(spark, sf_dir)
        p, inner = s.predicate(table, text)
        return query_subset(s.df(table), s.schema(table), p, columns, tables=inner, **page)

    return run


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = substitute("o_custkey = $1 OR o_orderpriority = $2", collect({"params[1]": "42", "params[2]": "2-HIGH"}))
    return _filter("orders", text)(spark, sf_dir)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(Source(spark, sf_dir).df("orders"), ["o_orderstatus", "o_orderpriority"])


def _from_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_from_counts(parse("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH')"), ["o_orderstatus", "o_orderpriority"])
    return count_from_groups(_counts(spark, sf_dir), plan)


def _routed(table: str, texts: list[str], columns: dict[str, str], key: str) -> Query:
    """Rows for each of many registered equality queries, found by one join."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Source(spark, sf_dir)
        hit = route.route_all(s.df(table), s.schema(table), {t: s.predicate(table, t)[0] for t in texts})
        return hit.select(*[F.col(c).alias(a) for c, a in columns.items()], key)

    return run


def _contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zset.contributors(where(Source(spark, sf_dir).df("orders"), parse("o_orderstatus = 'F'")), "o_custkey")


def _live(read: Callable) -> Query:
    return lambda spark, sf_dir: read(replay(spark, sf_dir))


def _feed(which: str) -> Query:
    """(version, op, key) of a live query's whole feed."""
    return _live(lambda r: r.engine.feed(getattr(r, which)).select("version", "op", "key"))


def _live_family(r) -> DataFrame:
    out = None
    for p, shape in r.family.items():
        part = r.engine.feed(shape).select(F.lit(p).alias("shape_key"), "version", "op", "key")
        out = part if out is None else out.unionByName(part)
    return out


def _live_value(fn: str, digits: int | None = None) -> Query:
    def read(r) -> DataFrame:
        out = r.engine.value(r.aggregates[fn])
        return out if digits is None else out.withColumn("value", F.round("value", digits))

    return _live(read)


_CUSTOMER_IN = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
_PROMO, _POOR = "l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')", "l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"
_ASIA = "c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = '{}'))"
#: WHERE texts that both sides run as they stand: name -> (table, where).
_SAME = {
    "filter_eq_text": ("orders", "o_orderstatus = 'F'"),
    "filter_eq_int": ("part", "p_size = 18"),
    "filter_neq": ("orders", "o_orderstatus <> 'O'"),
    "filter_lt": ("part", "p_size < 18"),
    "filter_lte": ("part", "p_size <= 18"),
    "filter_gt": ("part", "p_size > 18"),
    "filter_gte": ("part", "p_size >= 18"),
    "filter_text_range": ("part", "p_brand >= 'Brand#15' AND p_brand < 'Brand#2'"),
    "filter_float_range": ("supplier", "s_acctbal >= 100.25 AND s_acctbal < 5000.5"),
    "filter_like": ("part", "p_name LIKE '%widget%'"),
    "filter_like_underscore": ("part", "p_brand LIKE 'Brand#1_'"),
    "filter_not_like": ("part", "NOT (p_name LIKE 'cold%')"),
    "filter_and": ("orders", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "filter_or": ("orders", "o_orderpriority = '1-URGENT' OR o_totalprice > 200000"),
    "filter_nested_bool": ("orders", "o_orderstatus = 'F' AND (o_totalprice >= 100000 OR NOT (o_orderpriority = '5-LOW')) AND NOT (o_custkey < 100)"),
    "filter_const_predicate": ("nation", "373 = 373"),
    "filter_between": ("part", "p_size BETWEEN 10 AND 20"),
    "filter_not_between": ("part", "p_size NOT BETWEEN 10 AND 20"),
    "filter_in_list": ("customer", "c_mktsegment IN ('BUILDING','MACHINERY')"),
    "filter_not_in_list": ("customer", "c_mktsegment NOT IN ('BUILDING','MACHINERY')"),
    "subq_in": ("orders", _CUSTOMER_IN),
    "subq_in_no_where": ("customer", "c_custkey IN (SELECT o_custkey FROM orders)"),
    "subq_not_in": ("customer", "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "subq_not_of_in": ("customer", "NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000))"),
    "subq_nested_2": ("customer", _ASIA.format("ASIA")),
    "subq_nested_3": ("orders", f"o_custkey IN (SELECT c_custkey FROM customer WHERE {_ASIA.format('EUROPE')})"),
    "subq_side_table": ("documents", "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "subq_and_atomic": ("orders", f"{_CUSTOMER_IN} AND o_totalprice >= 100000"),
    "subq_or_atomic": ("orders", f"{_CUSTOMER_IN} OR o_orderstatus = 'P'"),
    "subq_two_anded": ("lineitem", f"{_PROMO} AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"),
    "subq_two_ored": ("lineitem", f"{_PROMO} OR {_POOR}"),
    "subq_and_of_ors": ("lineitem", f"({_PROMO} OR l_quantity > 45) AND ({_POOR} OR l_returnflag = 'R')"),
}

_SPARSE = "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS et FROM events) t"
_GONE = f"(o_orderkey % 11 = 0 OR o_totalprice >= {HIGH} * (SELECT MAX(o_totalprice) FROM orders))"
#: The orders after each commit of the replay.
_AT = {
    1: "(SELECT * FROM orders) f",
    2: f"(SELECT * FROM orders WHERE NOT {_GONE}) f",
    3: f"(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE NOT {_GONE}) f",
}
_FINAL = _AT[3]


def _steps(result: str, versions=(0, 1, 2, 3), before: str | None = None) -> str:
    """The feed (version, op, key) of a result over the commits: what each version brought and took.
    ``result`` is SQL with {} for the orders; ``before`` is the result before any commit, if there is one."""
    at = {0: before or f"SELECT * FROM ({result.format(_AT[1])}) r WHERE FALSE"} | {v: result.format(t) for v, t in _AT.items()}
    parts = [f"SELECT CAST({versions[0]} AS BIGINT) AS version, 'upsert' AS op, CAST(k AS VARCHAR) AS key FROM ({at[versions[0]]}) a"]
    for a, b in zip(versions, versions[1:]):
        for op, x, y in (("upsert", b, a), ("delete", a, b)):
            parts.append(f"SELECT {b}, '{op}', CAST(k AS VARCHAR) FROM (SELECT k FROM ({at[x]}) x EXCEPT SELECT k FROM ({at[y]}) y) d")
    return " UNION ALL ".join(parts)


_F_KEYS, _IN_F = "SELECT o_orderkey AS k FROM {} WHERE o_orderstatus = 'F'", "(SELECT o_custkey FROM {} WHERE o_orderstatus = 'F')"
_PAGE = ["o_orderkey", "o_totalprice"]
_BY_PRICE = ("o_totalprice", "desc")

#: name -> (query, SQL).
_OWN: dict[str, tuple[Query, str]] = {
    "scan_match_all": (_filter("customer", None), "SELECT * FROM customer"),
    "project_columns": (_filter("customer", "c_acctbal > 0", ["c_name", "c_mktsegment"]), "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0"),
    "filter_is_null": (_filter("sparse_events", "et IS NULL"), f"SELECT * FROM {_SPARSE} WHERE et IS NULL"),
    "filter_is_not_null": (_filter("sparse_events", "et IS NOT NULL"), f"SELECT * FROM {_SPARSE} WHERE et IS NOT NULL"),
    "filter_not_over_null": (_filter("sparse_events", "NOT (et = 'click')"), f"SELECT * FROM {_SPARSE} WHERE NOT (et = 'click')"),
    "filter_empty_and": (_filter("nation", And()), "SELECT * FROM nation WHERE TRUE"),
    "filter_empty_or": (_filter("nation", Or()), "SELECT * FROM nation WHERE FALSE"),
    "filter_json_ast": (_filter("orders", from_json({"and": [{"col": "o_orderstatus", "op": "eq", "value": "F"}, {"not": {"col": "o_totalprice", "op": "lt", "value": 100000}}]})), "SELECT * FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice < 100000)"),
    "filter_params": (_params, "SELECT * FROM orders WHERE o_custkey = 42 OR o_orderpriority = '2-HIGH'"),
    "subq_not_in_with_null": (_filter("customer", In("c_custkey", "sparse_orders", "o_custkey", None, True)), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END FROM orders)"),
    "agg_count_star": (_aggregate("orders", "count", None, "o_orderstatus = 'F'"), "SELECT COUNT(*) AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "agg_count_col": (_aggregate("sparse_events", "count", "et", None), f"SELECT COUNT(et) AS value, COUNT(*) AS n FROM {_SPARSE}"),
    "agg_sum": (_aggregate("lineitem", "sum", "l_quantity", "l_returnflag = 'R'", 2), "SELECT ROUND(SUM(CAST(l_quantity AS DOUBLE)), 2) AS value, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "agg_avg": (_aggregate("orders", "avg", "o_totalprice", "o_orderstatus = 'O'", 4), "SELECT ROUND(AVG(CAST(o_totalprice AS DOUBLE)), 4) AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'O'"),
    "agg_min": (_aggregate("orders", "min", "o_totalprice", "o_orderpriority = '1-URGENT'"), "SELECT MIN(o_totalprice) AS value, COUNT(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "agg_max": (_aggregate("orders", "max", "o_totalprice", "o_orderpriority = '1-URGENT'"), "SELECT MAX(o_totalprice) AS value, COUNT(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "agg_min_text": (_aggregate("part", "min", "p_name", "p_size > 10"), "SELECT MIN(p_name) AS value, COUNT(*) AS n FROM part WHERE p_size > 10"),
    "agg_sum_empty": (_aggregate("orders", "sum", "o_totalprice", "o_orderstatus = 'Z'"), "SELECT SUM(CAST(o_totalprice AS DOUBLE)) AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'Z'"),
    "agg_counts_pipeline": (_counts, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS cnt FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "agg_count_from_groups": (_from_groups, "SELECT COUNT(*) AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH')"),
    "subset_order_limit": (_subset("orders", None, _PAGE, order_by=_BY_PRICE, limit=50), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50"),
    "subset_offset": (_subset("orders", "o_orderstatus = 'F'", _PAGE, order_by=("o_totalprice", "asc"), limit=20, offset=40), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice ASC, o_orderkey ASC LIMIT 20 OFFSET 40"),
    "subset_pk_default_order": (_subset("customer", None, None, limit=10), "SELECT * FROM customer ORDER BY c_custkey ASC LIMIT 10"),
    "subset_keyset_page": (_subset("orders", None, _PAGE, order_by=_BY_PRICE, limit=25, after={"o_totalprice": 150000.0, "o_orderkey": 500}), "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey < 500)) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25"),
    "subset_subquery_page": (_subset("orders", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", ["o_orderkey", "o_orderdate"], order_by=("o_orderdate", "desc"), limit=20), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "route_equality_template": (_routed("orders", ["o_orderstatus = 'F'", "o_orderstatus = 'O'"], {"o_orderstatus": "shape_key"}, "o_orderkey"), "SELECT o_orderstatus AS shape_key, o_orderkey FROM orders WHERE o_orderstatus IN ('F','O')"),
    "route_multi_key": (_routed("customer", [f"c_nationkey = {n} AND c_mktsegment = '{m}'" for n in (1, 2) for m in ("BUILDING", "MACHINERY")], {"c_nationkey": "c_nationkey", "c_mktsegment": "c_mktsegment"}, "c_custkey"), "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer WHERE c_nationkey IN (1,2) AND c_mktsegment IN ('BUILDING','MACHINERY')"),
    "route_necessary_conjunct": (_routed("orders", ["o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_custkey < 50)", "o_orderstatus = 'O' AND NOT (o_totalprice < 300000)"], {"o_orderstatus": "shape_key"}, "o_orderkey"), "SELECT o_orderstatus AS shape_key, o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_custkey < 50)) OR (o_orderstatus = 'O' AND NOT (o_totalprice < 300000))"),
    "inner_set_contributors": (_contributors, "SELECT o_custkey AS value, COUNT(*) AS contributors FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "live_filter_final": (_live(lambda r: r.engine.rows(r.filter)), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_FINAL} WHERE o_orderstatus = 'F'"),
    "live_router_final": (_live(lambda r: r.router()), f"SELECT o_orderstatus AS shape_key, o_orderkey FROM {_FINAL}"),
    "live_subquery_final": (_live(lambda r: r.engine.rows(r.member)), f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {_FINAL} WHERE o_orderstatus = 'F')"),
    "live_not_in_final": (_live(lambda r: r.engine.rows(r.outsider)), f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_FINAL} WHERE o_orderstatus = 'F')"),
    "live_agg_count_final": (_live_value("count"), f"SELECT COUNT(*) AS value, COUNT(*) AS n FROM {_FINAL} WHERE o_orderstatus = 'F'"),
    "live_agg_sum_final": (_live_value("sum", 2), f"SELECT ROUND(SUM(o_totalprice), 2) AS value, COUNT(*) AS n FROM {_FINAL} WHERE o_orderstatus = 'F'"),
    "live_agg_max_retract": (_live_value("max"), f"SELECT MAX(o_totalprice) AS value, COUNT(*) AS n FROM {_FINAL} WHERE o_orderstatus = 'F'"),
    "live_filter_feed": (_feed("filter"), _steps(_F_KEYS)),
    "live_changes_only_feed": (_feed("changes"), _steps(_F_KEYS)),
    "live_subquery_feed": (_feed("member"), _steps(f"SELECT c_custkey AS k FROM customer WHERE c_custkey IN {_IN_F}")),
    "live_not_in_feed": (_feed("outsider"), _steps(f"SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN {_IN_F}", before="SELECT c_custkey AS k FROM customer")),
    "live_or_subquery_feed": (_feed("either"), _steps(f"SELECT c_custkey AS k FROM customer WHERE c_custkey < 100 OR c_custkey IN {_IN_F}", before="SELECT c_custkey AS k FROM customer WHERE c_custkey < 100")),
    "live_family_feed": (_live(_live_family), " UNION ALL ".join(f"SELECT '{p}' AS shape_key, * FROM (" + _steps(f"SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {{}} WHERE o_orderstatus = 'F' AND o_orderpriority = '{p}')") + ") s" for p in PRIORITIES)),
    "live_late_feed": (_feed("late"), _steps("SELECT o_orderkey AS k FROM {} WHERE o_totalprice < 50000", (1, 2, 3))),
    "live_woken_feed": (_feed("sleeper"), _steps("SELECT o_orderkey AS k FROM {} WHERE o_orderstatus = 'F' AND o_totalprice > 100000")),
    "live_agg_feed": (_live(lambda r: r.engine.feed(r.aggregates["max"]).select("version", F.col("value")["value"].cast("double").alias("value"), F.col("value")["n"].cast("long").alias("n"))), "SELECT CAST(0 AS BIGINT) AS version, CAST(NULL AS DOUBLE) AS value, CAST(0 AS BIGINT) AS n UNION ALL SELECT version, value, n FROM (SELECT *, LAG(value) OVER (ORDER BY version) AS was FROM (" + " UNION ALL ".join(f"SELECT {v} AS version, MAX(o_totalprice) AS value, COUNT(*) AS n FROM {t} WHERE o_orderstatus = 'F'" for v, t in _AT.items()) + ") v) w WHERE value IS DISTINCT FROM was"),
    "live_feed_fold_at_version": (_live(lambda r: r.engine.rows(r.filter, until=2)), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {_AT[2]} WHERE o_orderstatus = 'F'"),
    "live_trace": (_live(lambda r: r.engine.trace(r.filter)), "SELECT version, op, COUNT(*) AS rows FROM (" + _steps(_F_KEYS) + ") s GROUP BY version, op"),
    "live_contributors": (_live(lambda r: r.contributors()), f"SELECT o_custkey AS value, COUNT(*) AS w FROM {_FINAL} WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "live_counts_final": (_live(lambda r: r.engine.group_counts("orders").select("o_orderstatus", "o_orderpriority", F.col("cnt").cast("long").alias("cnt"))), f"SELECT o_orderstatus, o_orderpriority, COUNT(*) AS cnt FROM {_FINAL} GROUP BY o_orderstatus, o_orderpriority"),
}


def queries() -> dict[str, Query]:
    return {n: _filter(t, w) for n, (t, w) in _SAME.items()} | {n: q for n, (q, _) in (_OWN | PARTS).items()}


def oracle_sql() -> dict[str, str]:
    return {n: f"SELECT * FROM {t} WHERE {w}" for n, (t, w) in _SAME.items()} | {n: sql for n, (_, sql) in (_OWN | PARTS).items()}
