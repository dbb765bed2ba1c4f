"""The one rule: after a drain, what a feed folds to is what the query returns on the tables."""

import random

import pytest

from brooklet.operators.predicate import matches, validate
from brooklet.operators.where_parser import parse
from brooklet.schema import TableSchema, ValidationError
from brooklet.streaming import engine as engine_module
from brooklet.streaming import membership
from brooklet.streaming.engine import LiveEngine
from brooklet.streaming.protocol import MustRefetch, ShapeProtocol

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
USERS = TableSchema.from_json("users", {"columns": {"id": "int", "name": "text", "age": "int", "active": "bool", "score": "float"}, "primaryKey": "id"})
TEAMS = TableSchema.from_json("teams", {"columns": {"id": "int", "owner": "int", "open": "bool"}, "primaryKey": "id"})

SHAPES = [None, "age > 500", "name = 'alpha'", "name = 'bravo'", "active = true AND name = 'echo'", "NOT (age <= 300) OR score IS NULL", "name LIKE '%a' AND age IS NOT NULL",
          "id IN (SELECT owner FROM teams WHERE open = true)", "id IN (SELECT owner FROM teams WHERE open = false)", "name LIKE '%a' AND id IN (SELECT owner FROM teams WHERE id = 3 AND owner > 2)", "id IN (SELECT owner FROM teams WHERE id = 4 AND owner > 2) AND name LIKE '%a'", "id NOT IN (SELECT owner FROM teams WHERE open = true)", "age > 400 OR id IN (SELECT owner FROM teams)",
          "id IN (SELECT owner FROM teams WHERE id IN (SELECT age FROM users WHERE active = true) OR open = true)", "NOT (id IN (SELECT owner FROM teams WHERE owner NOT IN (SELECT id FROM users WHERE age > 500)))"]
AGGREGATES = [("count", None, None), ("count", "age", "active = true"), ("sum", "score", None), ("avg", "age", "name = 'alpha'"), ("min", "age", None), ("max", "name", "age > 100")]


class Model:
    """The tables in plain Python."""

    def __init__(self):
        self.tables = {"users": {}, "teams": {}}

    def apply(self, table, op, row):
        t = self.tables[table]
        if op == "truncate":
            t.clear()
        elif op == "delete":
            t.pop(row["id"], None)
        elif op == "update":
            if row["id"] in t:
                t[row["id"]] = t[row["id"]] | row
        else:
            t[row["id"]] = row

    def values(self, leaf):
        return {r[leaf.project] for r in self.tables[leaf.table].values() if matches(leaf.where, r, self.values)}

    def select(self, table, text):
        p = validate(parse(text), table, {"users": USERS, "teams": TEAMS})
        return {k: r for k, r in self.tables[table].items() if matches(p, r, self.values)}


def change(rng, nulls=0.2):
    cell = lambda v: None if rng.random() < nulls else v
    if rng.random() < 0.35:
        row = {"id": rng.randrange(10), "owner": cell(rng.randrange(24)), "open": cell(rng.random() < 0.5)}
        table = "teams"
    else:
        row = {"id": rng.randrange(24), "name": cell(rng.choice(WORDS)), "age": cell(rng.randrange(1000)), "active": cell(rng.random() < 0.5), "score": cell(round(rng.random() * 1000, 4))}
        table = "users"
    op = rng.choices(["insert", "upsert", "delete", "update"], [5, 4, 2, 2])[0]
    if op == "delete":
        row = {"id": row["id"]}
    elif op == "update":
        row = {"id": row["id"]} | {c: row[c] for c in rng.sample([c for c in row if c != "id"], 1)}
    return table, op, row


def engine_with(spark, root):
    e = LiveEngine(spark, f"file://{root}")
    for s in (USERS, TEAMS):
        e.define_table(s, counts=["name", "active"] if s is USERS else None)
    return e


def write(e, model, changes):
    e.log.append([e.log.change(e.schemas[t], op, {"id": row["id"]} if op == "delete" else None, None if op == "delete" else row) for t, op, row in changes])
    for t, op, row in changes:
        model.apply(t, op, row)


def check(e, model, shapes, aggs):
    for i, text in shapes.items():
        got = {r["id"]: r.asDict() for r in e.rows(i).collect()}
        assert got == model.select("users", text), text
    for i, (fn, col, text) in aggs.items():
        rows = model.select("users", text).values()
        cells = [r[col] for r in rows if r[col] is not None] if col else list(rows)
        want = len(cells) if fn == "count" else None if not cells else sum(cells) if fn == "sum" else sum(cells) / len(cells) if fn == "avg" else min(cells) if fn == "min" else max(cells)
        got = e.value(i).first()
        assert got["n"] == len(rows) and (got["value"] == pytest.approx(want) if isinstance(want, float) else got["value"] == want), (fn, col, text)


@pytest.mark.parametrize("seed", [12345])
def test_random_changes(spark, tmp_path, monkeypatch, seed):
    rng, model = random.Random(seed), Model()
    e = engine_with(spark, tmp_path)
    monkeypatch.setattr(engine_module, "MOST_PARTS", 4)
    monkeypatch.setattr(engine_module, "MOST_FEEDS", 25)
    monkeypatch.setattr(membership, "MOST_DELTAS", 1)
    shapes = {e.create_shape("users", t): t for t in SHAPES}
    aggs = {e.create_aggregate("users", fn, col, t): (fn, col, t) for fn, col, t in AGGREGATES}
    assert e.create_shape("users", "name = 'alpha' AND active = true AND age > 1") != e.create_shape("users", "age > 1 AND name = 'alpha'")
    assert e.create_shape("users", "age > 500") in shapes  # an equal query is shared
    for round_ in range(3):
        for _ in range(2):
            write(e, model, [change(rng) for _ in range(25)])
        if round_ == 2:
            e.write("teams", "truncate")
            model.apply("teams", "truncate", None)
        e.run()
        check(e, model, shapes, aggs)
    want = {}
    for r in model.tables["users"].values():
        want[r["name"], r["active"]] = want.get((r["name"], r["active"]), 0) + 1
    assert {(r["name"], r["active"]): r["cnt"] for r in e.group_counts("users").collect()} == want
    # a restart goes on from the catalog and the checkpoint
    again = LiveEngine(spark, f"file://{tmp_path}")
    assert again.version == e.version and set(again.shapes) == set(e.shapes) and again.sets.marks() == e.sets.marks() and again.feeds == e.feeds != set()
    late = {again.create_shape("users", "score > 1", ["name"]): None}
    write(again, model, [change(rng) for _ in range(20)])
    again.run()
    check(again, model, shapes, aggs)
    assert {r["id"] for r in again.rows(next(iter(late))).collect()} == set(model.select("users", "score > 1"))
    # many at once: plain ones, a family, repeats and one that is known already
    texts = ["age < 100", "name = 'delta'", "id IN (SELECT owner FROM teams WHERE id = 1)", "id IN (SELECT owner FROM teams WHERE id = 2)", "age < 100", "age > 500", "id NOT IN (SELECT owner FROM teams WHERE id = 2)"]
    many = again.create_shapes("users", texts)
    assert many[0] == many[4] and many[5] in shapes and again.shapes[many[0]].record.refs == 2 and len(set(many)) == 6
    for i, t in zip(many, texts, strict=True):
        assert {r["id"] for r in again.rows(i).collect()} == set(model.select("users", t)), t
    assert set(LiveEngine(spark, f"file://{tmp_path}").shapes) == set(again.shapes)
    write(again, model, [change(rng) for _ in range(30)])
    again.run()
    for i, t in zip(many, texts, strict=True):
        assert {r["id"] for r in again.rows(i).collect()} == set(model.select("users", t)), t
    # dormant, changed meanwhile, awake
    sleeper = again.create_shape("users", "age < 250")
    again.release(sleeper)
    from brooklet.streaming.retention import Limits

    assert sleeper in again.sweep(Limits(idle=1), now=__import__("time").monotonic() + 5).deactivate
    write(again, model, [change(rng) for _ in range(20)])
    again.run()
    again.create_shape("users", "age < 250")
    assert {r["id"] for r in again.rows(sleeper).collect()} == set(model.select("users", "age < 250"))


def test_every_commit_leaves_its_trace(spark, tmp_path):
    """Commits of one drain are versions of their own, queries that a change cannot concern are passed
    over, and what only a dropped query used goes with it."""
    e = LiveEngine(spark, f"file://{tmp_path}", flush="commit")
    for s in (USERS, TEAMS):
        e.define_table(s)
    row = {"id": 7, "name": "alpha", "age": 9, "active": True, "score": 1.0}
    plain = e.create_shape("users", "age > 5", ["id"])
    inner = e.create_shape("users", "age < 100 AND id IN (SELECT owner FROM teams WHERE open = true)", ["id"])
    other = e.create_shape("users", "age > 900 AND id IN (SELECT owner FROM teams WHERE open = true)", ["id"])
    e.write("users", "insert", row=row)
    e.write("teams", "insert", row={"id": 1, "owner": 7, "open": True})
    e.write("teams", "update", {"id": 1}, {"open": False})
    e.write("users", "update", {"id": 7}, {"name": "bravo"})
    e.write("users", "delete", {"id": 7})
    e.run()
    fed = lambda i: [(r["version"], r["op"], r["key"]) for r in e.feed(i).orderBy("version").collect()]
    assert e.version == 5 and fed(plain) == [(1, "upsert", "7"), (5, "delete", "7")]
    assert fed(inner) == [(2, "upsert", "7"), (3, "delete", "7")] and fed(other) == []
    assert e.metrics.counters["queries_passed_over"] >= 3
    node = e.sets.node(_first_subquery(e, inner))
    assert set(e.sets.nodes) == {node.id} and [(r["value"], r["w"]) for r in e.sets.state(node, 2).collect()] == [(7, 1)]
    sizes = e.feed_bytes()
    assert sizes[plain] > 0 and inner in sizes
    from brooklet.streaming.retention import Limits

    for i in (plain, other):
        e.release(i)
    e.sweep(Limits(idle=1), now=__import__("time").monotonic() + 5)
    assert e.sweep(Limits(idle=0, most_bytes=sizes[inner])).evict[0] in (plain, other)
    e.purge(inner)
    if other in e.shapes:
        e.purge(other)
    assert not e.sets.nodes and not LiveEngine(spark, f"file://{tmp_path}").sets.nodes


def _first_subquery(e, shape):
    from brooklet.operators.predicate import subqueries

    return subqueries(e.shapes[shape].predicate)[0]


def test_a_broken_engine_is_caught(spark, tmp_path):
    e, model = engine_with(spark, tmp_path), Model()
    shape = e.create_shape("users", "age > 5")
    e.faults.add("drop_deletes")
    row = {"id": 1, "name": "alpha", "age": 9, "active": True, "score": 1.0}
    write(e, model, [("users", "insert", row)])
    e.run()
    check(e, model, {shape: "age > 5"}, {})
    write(e, model, [("users", "delete", {"id": 1})])
    e.run()
    with pytest.raises(AssertionError):
        check(e, model, {shape: "age > 5"}, {})


def test_protocol_and_live_pages(spark, tmp_path):
    from brooklet.client import Client

    c = Client(spark, f"file://{tmp_path}")
    c.define_schema("users", USERS.to_json())
    for i, age in enumerate([30, None, 10, 20]):
        c.insert_row("users", {"id": i, "name": "x", "age": age})
    c.drain()
    first = c.protocol.get({"table": "public.users", "where": "age > $1", "params[1]": "15", "offset": "-1"})
    assert [m["headers"].get("operation") for m in first["messages"]] == ["insert", "insert", None]
    assert first["messages"][0]["value"]["age"] == "30" and first["headers"]["schema"]["id"] == {"type": "int8", "pk_index": 0}
    h = {"table": "users", "handle": first["headers"]["handle"], "offset": first["headers"]["offset"]}
    assert c.protocol.get(h)["status"] == 204
    page, feed = c.live_subset("users", None, ("age", "desc"), 2)
    assert [r["id"] for r in page.ordered()] == [1, 0]  # descending: NULLs first
    seen = []
    feed.subscribe(seen.extend)
    lsn = c.write("users", "update", {"id": 3}, {"age": 40})
    c.delete_rows("users", [{"id": 0}])
    feed.await_commit(lsn + 1)
    assert {(x["op"], x["key"]) for x in seen} == {("upsert", "3"), ("delete", "0")}
    for x in seen:
        row = None if x["value"] is None else {"id": int(x["value"]["id"]), "age": None if x["value"]["age"] is None else int(x["value"]["age"])}
        page.merge(x["op"], x["key"], row, c.engine.version)
    assert [r["id"] for r in page.ordered()] == [1, 3]
    live = c.protocol.get(h)
    assert [(m["headers"].get("operation"), m.get("key")) for m in live["messages"]] == [("update", "3"), ("delete", "0"), (None, None)]
    assert [r["key"] for r in c.protocol.rows(c.protocol.handles[h["handle"]].shape_id)] == ["3"]
    for bad, error in (({"table": "users", "offset": "5"}, ValidationError), ({"table": "users", "offset": "0", "handle": "no"}, MustRefetch), ({"table": "t", "offset": "0", "handle": h["handle"]}, ValidationError), ({"table": "users", "where": "nope = 1", "offset": "-1"}, ValidationError)):
        with pytest.raises(error):
            c.protocol.get(bad)
    c.protocol.get(h)
    c.protocol._expire(float("inf"))
    with pytest.raises(MustRefetch):
        c.protocol.get(h)
    with pytest.raises(ValidationError):
        c.write("users", "insert", None, {"name": "no key"})
    with pytest.raises(ValidationError):
        c.aggregate("users", "sum", "name")
    assert c.engine.describe(next(iter(c.engine.shapes)))["nodes"][0] == {"op": "source", "table": "users"} and c.engine.health()["status"] == "active"
    assert isinstance(c.protocol, ShapeProtocol)
    assert c.engine.metrics.summary()["batches"] == 2 and "brooklet_batches 2" in c.engine.metrics.prometheus()
    members = c.engine.create_shape("users", "id IN (SELECT id FROM users WHERE age IN (SELECT age FROM users))")
    assert c.engine.subqueries() == {"users|id|I(age,false,users|age|*)": 1, "users|age|*": 1}
    assert {r["op"] for r in c.engine.trace(members).collect()} == {"upsert"}
