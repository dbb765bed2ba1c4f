import random
import struct

from pyspark.sql import functions as F

from brooklet.functions import zset
from brooklet.operators.aggregate import Aggregate, aggregate, count_from_groups, group_counts, plan_from_counts
from brooklet.operators.subset import comparator, keyset, query_subset
from brooklet.operators.where_parser import parse
from brooklet.schema import TableSchema
from brooklet.sources.gate import SnapshotGate, lsn_column, parse_lsn
from brooklet.sources.pgoutput import decode, envelopes
from brooklet.streaming.live_subset import LiveSubset
from brooklet.streaming.retention import Limits, ShapeUse, plan

T1 = TableSchema.from_json("t", {"columns": {"id": "int", "v": "int"}, "primaryKey": "id"})


def test_zset(spark):
    rows = spark.createDataFrame([("a", (1, 2), (1, 3)), ("b", None, (2, 2)), ("c", (3, 3), None), ("d", (4, 4), (4, 4))], "key string, old struct<id:int,v:int>, new struct<id:int,v:int>")
    d = zset.delta(rows)
    assert {(r["key"], r["row"]["v"], r["__w"]) for r in d.collect()} == {("a", 2, -1), ("a", 3, 1), ("b", 2, 1), ("c", 3, -1)}
    assert {(r["key"], r["op"], r["row"] and r["row"]["v"]) for r in zset.feed(d, ["key"]).collect()} == {("a", "upsert", 3), ("b", "upsert", 2), ("c", "delete", None)}
    a, b = spark.createDataFrame([(1,), (None,)], "value int"), spark.createDataFrame([(1,), (2,)], "value int")
    assert {(r["value"], r["now"]) for r in zset.flips(a, b).collect()} == {(None, False), (2, True)}
    e = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (None, None), (None, None)], "l long, s long")
    assert sorted((r["l"] or 0, r["s"] or 0) for r in zset.dedup(e, (1, 0), F.col("l"), F.col("s")).collect()) == [(0, 0), (0, 0), (1, 1), (2, 0)]


def test_gate(spark):
    assert parse_lsn("16/B374D848") == (0x16 << 32) + 0xB374D848
    g = SnapshotGate(lsn=100, xmin=10, xmax=20, xip=(12, 15))
    cases = [(9, 500), (10, 500), (12, 1), (19, 500), (20, 1), (None, 99), (None, 100), (None, None)]
    assert [g.skips(*c) for c in cases] == [True, True, False, True, False, True, False, False]
    df = spark.createDataFrame(cases, "x long, l long").select("x", "l", g.skipped(F.col("x"), F.col("l")).alias("s"), lsn_column(F.lit("16/B374D848")).alias("p"))
    got = df.collect()
    assert [r["s"] for r in got] == [g.skips(*c) for c in cases] and got[0]["p"] == parse_lsn("16/B374D848")
    assert not SnapshotGate(lsn=9, passthrough=True).skips(1, 1)


def _text(s):
    return s.encode() + b"\0"


def _tuple(*cells):
    out = struct.pack("!h", len(cells))
    for c in cells:
        out += b"n" if c is None else b"u" if c is ... else b"t" + struct.pack("!i", len(c)) + c.encode()
    return out


def test_pgoutput():
    rel = b"R" + struct.pack("!i", 7) + _text("public") + _text("t") + b"d" + struct.pack("!h", 2) + b"".join(struct.pack("!b", k) + _text(n) + struct.pack("!ii", 20, -1) for k, n in ((1, "id"), (0, "v")))
    other = rel.replace(struct.pack("!i", 7), struct.pack("!i", 8), 1).replace(b"\0t\0", b"\0x\0")
    begin, commit = b"B" + struct.pack("!qqi", 900, 0, 55), b"C" + struct.pack("!bqqq", 0, 900, 901, 0)
    messages = [rel, other, begin, b"I" + struct.pack("!i", 7) + b"N" + _tuple("1", "5"), b"I" + struct.pack("!i", 8) + b"N" + _tuple("1", "5"),
                b"U" + struct.pack("!i", 7) + b"O" + _tuple("1", "5") + b"N" + _tuple("1", ...), b"U" + struct.pack("!i", 7) + b"K" + _tuple("1", None) + b"N" + _tuple("2", ...),
                b"D" + struct.pack("!i", 7) + b"K" + _tuple("2", None), b"T" + struct.pack("!ib", 1, 0) + struct.pack("!i", 7), b"Y" + b"xx", commit]
    got = list(envelopes(iter(messages), {"t": T1}))
    assert [(e["headers"]["operation"], e["key"], e["value"]) for e in got] == [("insert", "1", {"id": "1", "v": "5"}), ("update", "1", {"id": "1", "v": "5"}), ("delete", "1", None), ("update", "2", {"id": "2"}), ("delete", "2", None), ("truncate", None, None)]
    assert [e["headers"]["seq"] for e in got] == list(range(6)) and all(e["headers"]["lsn"] == 900 and e["headers"]["txid"] == 55 for e in got)
    try:
        decode(b"I" + struct.pack("!i", 7) + b"N" + struct.pack("!h", 3))
    except ValueError:
        pass
    else:
        raise AssertionError("a cut message was read")


def test_retention():
    s = [ShapeUse("a", 0, 2000), ShapeUse("b", 1, 9e9), ShapeUse("c", 0, 9e9, 700_000), ShapeUse("d", 0, 700_000, can_sleep=False), ShapeUse("e", 0, 5, in_transition=True), ShapeUse("f", 0, 1)]
    p = plan(s, Limits())
    assert p.deactivate == ["a"] and p.evict == ["c", "d"] and not p.over_capacity
    lru = [ShapeUse(str(i), 0, i, 1.0, bytes=10) for i in range(5)] + [ShapeUse("x", 1, 0, bytes=10)]
    p = plan(lru, Limits(most_shapes=4, most_bytes=30))
    assert p.evict == ["4", "3", "2"]
    p = plan(lru, Limits(most_shapes=0, most_bytes=5))
    assert len(p.evict) == 5 and p.over_budget and not p.over_capacity
    assert plan(s, Limits(idle=0, ttl=0)).deactivate == []


def test_aggregates_and_counts(spark):
    t = TableSchema.from_json("t", {"columns": {"id": "int", "g": "text", "h": "text", "v": "int"}, "primaryKey": "id"})
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", None), (3, None, "x", 7), (4, "b", "x", 1)], t.struct())
    assert aggregate(df, t, Aggregate("sum", "v"), parse("g = 'zz'")).first() == (None, 0)
    assert aggregate(df, t, Aggregate("avg", "v")).first() == (13 / 3, 4) and aggregate(df, t, Aggregate("count", "v")).first() == (3, 4)
    counts = group_counts(df, ["g", "h"])
    for text, want in (("g = 'a'", 2), ("g IN ('a','b') AND h = 'x'", 2), ("", 4)):
        assert count_from_groups(counts, plan_from_counts(parse(text), ["g", "h"])).first() == (want, want)
    from brooklet.operators.predicate import Leaf

    assert count_from_groups(counts, plan_from_counts(Leaf("g", "eq", None), ["g", "h"])).first() == (0, 0)
    for text in ("v = 1", "g > 'a'", "g = 'a' OR h = 'x'", "g = 'a' AND g = 'b'", "NOT (g = 'a')"):
        assert plan_from_counts(parse(text), ["g", "h"]) is None


def test_pages(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, 3])) for i in range(40)]
    df = spark.createDataFrame(rows, T1.struct())
    for order in (("v", "asc"), ("v", "desc"), None, ("id", "desc")):
        want = sorted(({"id": i, "v": v} for i, v in rows), key=comparator(T1, order))
        seen, last = [], None
        while True:
            page = [r.asDict() for r in query_subset(df, T1, None, None, order, 13, after=last).collect()]
            seen += page
            if len(page) < 13:
                break
            last = page[-1]
        assert seen == want
        assert df.filter(keyset(T1, order, want[-1])).count() == 0
    assert query_subset(df, T1, limit=-3).count() == 0 and query_subset(df, T1, None, ["v"], None, 5, 38).columns == ["id", "v"]


def test_live_subset_merge():
    s = LiveSubset(T1, ("v", "asc"), 2)
    assert [e[0] for e in s.load([{"id": 1, "v": 10}, {"id": 2, "v": 20}], 5)] == ["insert", "insert"]
    assert s.merge("upsert", "3", {"id": 3, "v": 15}, 4) is None  # older than the page
    assert s.merge("upsert", "3", {"id": 3, "v": 15}, 6)[0] == "insert" and s.merge("upsert", "4", {"id": 4, "v": 99}, 6) is None
    assert s.merge("upsert", "1", {"id": 1, "v": 50}, 7) == ("delete", "1", None)  # left the window
    assert s.merge("delete", "2", None, 7) == ("delete", "2", None) and s.merge("delete", "2", None, 8) is None
    assert s.load([{"id": 1, "v": 50}], 6) == []  # read before it moved
    assert s.ended and s.merge("upsert", "9", {"id": 9, "v": None}, 9)[0] == "insert" and [r["id"] for r in s.ordered()] == [3, 9]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "subq_in" in q
    assert entry.entry(spark).count() > 0


def test_replication_source_feeds_the_engine(spark, tmp_path):
    import json

    from brooklet.sources.replication import PgOutput, frame
    from brooklet.streaming.engine import LiveEngine

    rel = b"R" + struct.pack("!i", 7) + _text("public") + _text("t") + b"d" + struct.pack("!h", 2) + b"".join(struct.pack("!b", k) + _text(n) + struct.pack("!ii", 20, -1) for k, n in ((1, "id"), (0, "v")))
    begin = lambda lsn: b"B" + struct.pack("!qqi", lsn, 0, lsn)
    commit = lambda lsn: b"C" + struct.pack("!bqqq", 0, lsn, lsn, 0)
    row = lambda kind, *cells: kind + struct.pack("!i", 7) + b"N" + _tuple(*cells)
    folder = tmp_path / "segments"
    folder.mkdir()
    (folder / "1.seg").write_bytes(frame([rel, begin(5), row(b"I", "1", "10"), row(b"I", "2", "20"), commit(5)]))
    (folder / "2.seg").write_bytes(frame([rel, begin(9), row(b"U", "1", ...), row(b"U", "2", "x"), b"D" + struct.pack("!i", 7) + b"K" + _tuple("9", None), commit(9)]))
    spark.dataSource.register(PgOutput)
    e = LiveEngine(spark, f"file://{tmp_path}/engine")
    e.define_table(T1)
    shape = e.create_shape("t", "v IS NULL OR v > 5")
    lines = spark.readStream.format("pgoutput").option("tables", json.dumps({"t": T1.to_json()})).load(str(folder))
    q = lines.writeStream.foreachBatch(e._batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["id"], r["v"]) for r in e.rows(shape).collect()} == {(1, 10), (2, None)}  # unchanged stays, unreadable is NULL
    assert spark.read.format("pgoutput").option("tables", json.dumps({"t": T1.to_json()})).load(str(folder)).count() == 5
