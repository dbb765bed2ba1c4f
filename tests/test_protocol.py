"""Messages of the protocol stay in the cluster until they are read."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from brooklet.schema import TableSchema
from brooklet.streaming import engine as engine_module
from brooklet.streaming.engine import LiveEngine
from brooklet.streaming.protocol import UP_TO_DATE, MustRefetch, ShapeProtocol

ITEMS = TableSchema.from_json("items", {"columns": {"id": "int", "n": "int"}, "primaryKey": "id"})
ROWS = 3000


@pytest.fixture
def items(spark, tmp_path):
    e = LiveEngine(spark, f"file://{tmp_path}")
    e.define_table(ITEMS, spark.range(ROWS).selectExpr("id", "id % 10 AS n"))
    return e, ShapeProtocol(e)


def step(e, op, rows, columns=None):
    e.log.append_rows(ITEMS, op, rows, columns=columns)
    e.run()


def seen(messages):
    return [(m["headers"].get("operation"), m.get("key"), (m.get("value") or {}).get("n")) for m in messages]


def test_no_response_brings_its_rows_to_the_driver(spark, items, monkeypatch):
    e, protocol = items
    collected, collect = [], DataFrame.collect

    def counted(self):
        collected.append(len(rows := collect(self)))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    first = protocol.get({"table": "items", "where": "n < 9", "offset": "-1"})
    step(e, "delete", spark.range(ROWS).filter("id % 2 = 0").selectExpr("id", "id AS n"))
    live = protocol.get({"table": "items"} | {k: first["headers"][k] for k in ("handle", "offset")})
    assert max(collected) < 100
    assert len(first["messages"]) == ROWS * 9 // 10 + 1 and len(live["messages"]) == ROWS // 2 + 1
    assert first["messages"].frame().columns == ["operation", "key", "value"] and max(collected) < 100


def test_messages_are_those_of_their_versions(spark, items, monkeypatch):
    e, protocol = items
    first = protocol.get({"table": "items", "where": "id < 12", "offset": "-1"})
    ask = {"table": "items"} | {k: first["headers"][k] for k in ("handle", "offset")}
    assert protocol.get(ask)["status"] == 204
    step(e, "delete", spark.createDataFrame([(2, 0), (10, 0)], "id long, n long"))
    step(e, "upsert", spark.createDataFrame([(10, 7), (3, 8), (50, 1)], "id long, n long"))
    live = protocol.get(ask)
    monkeypatch.setattr(engine_module, "MOST_FEEDS", 0)
    step(e, "delete", spark.createDataFrame([(3, 0), (0, 0)], "id long, n long"))  # folds the feeds that both were made of
    assert seen(first["messages"]) == [("insert", str(i), str(i % 10)) for i in range(12)] + [(None, None, None)]
    assert seen(live["messages"]) == [("delete", "2", "2"), ("delete", "10", "0"), ("update", "3", "8"), ("insert", "10", "7"), (None, None, None)]
    assert first["messages"][-1] == live["messages"][4] == UP_TO_DATE and seen(first["messages"][1:3]) == [("insert", "1", "1"), ("insert", "2", "2")]
    after = protocol.get(ask | {"offset": live["headers"]["offset"]})
    assert seen(after["messages"]) == [("delete", "0", "0"), ("delete", "3", "8"), (None, None, None)]
    e.purge(protocol.handles[ask["handle"]].shape_id)
    with pytest.raises(MustRefetch):
        list(first["messages"])


def test_the_driver_does_not_build_joins_of_many_keys(spark, items):
    e, _ = items
    many, few = 30_000, 200
    e.log.append_rows(ITEMS, "upsert", spark.range(many).selectExpr("id", "id % 7 AS n"))
    e.run()
    joins = lambda version: e.table("items", version)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in joins(1) and "strategy=broadcast" not in joins(1)
    e.states["items"].deltas[1] = few
    assert "strategy=broadcast" in joins(1)
