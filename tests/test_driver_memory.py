"""What live queries leave in the driver: few rows, and no broadcasts of plans that have ended."""

import gc
import os
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from brooklet.plans import catalog
from brooklet.schema import TableSchema
from brooklet.streaming import engine as engine_module
from brooklet.streaming import membership
from brooklet.streaming.engine import LiveEngine

DATA = "/root/testdata/sf0.001"
ITEMS = TableSchema.from_json("items", {"columns": {"id": "int", "n": "int"}, "primaryKey": "id"})
#: Rows that a live query may bring to the driver: a page of 200, the 40 that a view shows, values of aggregates.
MOST_ROWS = 300
QUERIES = [
    "live_contributors",
    "live_family_feed",
    "live_filter_feed",
    "live_late_feed",
    "live_not_in_feed",
    "live_or_subquery_feed",
    "live_router_final",
    "live_subquery_final",
    "live_woken_feed",
    "proto_rows_view",
    "live_agg_count_final",
    "live_agg_max_retract",
    "live_changes_only_feed",
    "live_counts_final",
    "live_feed_fold_at_version",
    "live_filter_final",
    "live_membership_probe",
    "live_not_in_final",
    "live_page_merge",
    "live_subquery_feed",
]


def held(spark) -> int:
    """Bytes of broadcasts that the driver's block store holds, in a local session."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().memoryManager().storageMemoryUsed()


def settled(spark) -> int:
    """What is held once all garbage of before is gone; Spark's cleaner works beside."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    was, now = -1, held(spark)
    while now != was:
        time.sleep(1)
        was, now = now, held(spark)
    return now


def test_the_driver_lets_go_of_the_broadcasts_of_ended_plans(spark, tmp_path, monkeypatch):
    left = {}
    for share in (1.0, 0.0):
        monkeypatch.setattr(engine_module, "HEAP_SHARE", share)
        e = LiveEngine(spark, f"file://{tmp_path}/{share}")
        e.define_table(ITEMS, spark.range(100).selectExpr("id", "id % 10 AS n"))
        e.create_aggregate("items", "max", "n")
        before = settled(spark)
        for i in range(3):
            e.log.append_rows(ITEMS, "upsert", spark.range(20).selectExpr("id", f"id + {i} AS n"))
            e.run()
        for _ in range(20):
            left[share] = held(spark) - before
            if share or left[share] < left[1.0] / 4:
                break
            time.sleep(0.5)
    assert left[1.0] > 0 and left[0.0] < left[1.0] / 4


def test_what_plans_freed_beside_the_heap_is_given_back(spark, tmp_path, monkeypatch):
    given = []
    monkeypatch.setattr(engine_module, "trim", lambda s, f=engine_module.trim: given.append(f(s)))
    for share, some in ((1.0, False), (0.0, True)):
        monkeypatch.setattr(engine_module, "HEAP_SHARE", share)
        e = LiveEngine(spark, f"file://{tmp_path}/{share}")
        e.define_table(ITEMS, spark.range(100).selectExpr("id", "id % 10 AS n"))
        e.create_aggregate("items", "max", "n")
        assert bool(given) == some and all(given)


@pytest.fixture(scope="module")
def collected(spark, tmp_path_factory):
    """A folder of its own, whose replay is made by the first query that is asked, and the rows that reached the driver."""
    folder = f"{tmp_path_factory.mktemp('in')}/sf0.001"
    os.symlink(DATA, folder)
    rows, collect, local = [0], DataFrame.collect, DataFrame.toLocalIterator

    def counted(self):
        rows.append(len(found := collect(self)))
        return found

    def iterated(self, *a, **b):
        for r in local(self, *a, **b):
            rows[0] += 1
            yield r

    with pytest.MonkeyPatch.context() as m:
        m.setattr(engine_module, "HEAP_SHARE", 0.05)
        m.setattr(DataFrame, "collect", counted)
        m.setattr(DataFrame, "toLocalIterator", iterated)
        yield folder, rows, collect


@pytest.mark.parametrize("name", QUERIES)
def test_a_live_query_brings_few_rows_to_the_driver(spark, collected, name):
    folder, rows, collect = collected
    got = catalog.queries()[name](spark, folder)
    assert max(rows) <= MOST_ROWS
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert Counter(tuple(r) for r in collect(got)) == Counter(db.execute(catalog.oracle_sql()[name]).fetchall())


def test_a_probe_of_more_customers_than_are_broadcast_shuffles_them(spark, collected, monkeypatch):
    folder, _, collect = collected
    rows = {}
    for most in (10, 20_000):  # 75 customers are asked for
        monkeypatch.setattr(membership, "BROADCAST_VALUES", most)
        got = catalog.queries()["live_membership_probe"](spark, folder)
        assert ("strategy=broadcast" in got._jdf.queryExecution().analyzed().toString()) == (most > 75)
        rows[most] = sorted(collect(got))
    assert rows[10] == rows[20_000]
