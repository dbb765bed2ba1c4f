import itertools

import pytest

from brooklet.operators.params import collect, substitute
from brooklet.operators.predicate import And, In, IsNull, Leaf, Not, Or, canonical, equality_template, evaluate, from_json, like, matches, necessary_conjunct, null_sensitive, subquery_template, to_json, to_sql, validate
from brooklet.operators.where_parser import parse
from brooklet.schema import ColumnDef, TableSchema, ValidationError, coerce

USERS = TableSchema("users", {"id": ColumnDef("int"), "name": ColumnDef("text"), "age": ColumnDef("int"), "active": ColumnDef("bool"), "score": ColumnDef("float")}, ("id",))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", None), ("true", None), ("a = 1", Leaf("a", "eq", 1)), ("a != 'x''y'", Leaf("a", "neq", "x'y")), ('"A b" >= -1.5e2', Leaf("A b", "gte", -150.0)),
        ("a = 1 OR b = 2 AND NOT c = 3", Or((Leaf("a", "eq", 1), And((Leaf("b", "eq", 2), Not(Leaf("c", "eq", 3))))))),
        ("(a = 1 or b = 2) and c is not null", And((Or((Leaf("a", "eq", 1), Leaf("b", "eq", 2))), IsNull("c", False)))),
        ("a between 1 and 2", And((Leaf("a", "gte", 1), Leaf("a", "lte", 2)))), ("a not in (1, 2)", Not(Or((Leaf("a", "eq", 1), Leaf("a", "eq", 2))))),
        ("a NOT IN (SELECT b FROM t WHERE c = TRUE)", In("a", "t", "b", Leaf("c", "eq", True), True)), ("NOT (a IN (SELECT b FROM t))", Not(In("a", "t", "b"))),
        ("373 = 373", And()), ("1 = 2", Or()), ("1 = 'a'", Or()), ("1 <> 'a'", And()), ("1 < 'a'", Or()), ("a NOT LIKE 'x%'", Not(Leaf("a", "like", "x%"))), ("a = 9223372036854775808", Leaf("a", "eq", 9223372036854775808.0)),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree
    assert from_json(to_json(tree)) == tree


@pytest.mark.parametrize("text", ["a =", "a = 1 b", "a NOT IS NULL", "a = 1x", "a = NULL", "a + 1 = 2", "(a = 1", "a IN ()", "f(a) = 1", "a = 1e999", "a ~ 1", "a = 1.2.3"])
def test_parse_errors(text):
    with pytest.raises(ValidationError):
        parse(text)


def test_params():
    assert collect({"params[1]": "a", "params[2]": None, "params": '{"1":"z"}'}) == {1: "a", 2: ""}
    assert collect({"params": '{"1": 5, "2": true}'}) == {1: "5", 2: "true"}
    assert substitute("a = $1 AND b = '$1' AND c = $10", {1: "x'y", 10: "k"}) == "a = 'x''y' AND b = '$1' AND c = 'k'"
    with pytest.raises(ValidationError, match=r"parameter \$2 was not provided"):
        substitute("a = $2", {1: "x"})
    for bad in ({"params[0]": "a"}, {"params[2]": "a"}, {"params[x]": "a"}):
        with pytest.raises(ValidationError):
            collect(bad)


def test_coerce():
    assert (coerce("int", "5"), coerce("bool", "t"), coerce("bool", "False"), coerce("float", 1), coerce("float", "1.5")) == (5, True, False, 1.0, 1.5)
    for kind, v in (("int", "x"), ("int", 1.0), ("int", True), ("bool", 1), ("text", 1), ("float", "nan"), ("bool", "yes")):
        with pytest.raises(ValidationError):
            coerce(kind, v)


def test_validate():
    schemas = {"users": USERS}
    assert validate(Leaf("age", "eq", "5"), "users", schemas) == Leaf("age", "eq", 5)
    for p in (Leaf("nope", "eq", 1), Leaf("age", "like", "1%"), In("age", "t", "x"), In("age", "users", "x"), Not(Leaf("active", "eq", 3))):
        with pytest.raises(ValidationError):
            validate(p, "users", schemas)


def test_three_valued():
    tri = [True, False, None]
    leaf = {True: IsNull("n"), False: IsNull("n", False), None: Leaf("n", "eq", 1)}
    row = {"n": None, "x": 3}
    for a, b in itertools.product(tri, tri):
        both = evaluate(And((leaf[a], leaf[b])), row)
        either = evaluate(Or((leaf[a], leaf[b])), row)
        assert both is (False if False in (a, b) else None if None in (a, b) else True)
        assert either is (True if True in (a, b) else None if None in (a, b) else False)
    assert evaluate(And(), row) is True and evaluate(Or(), row) is False and evaluate(Not(leaf[None]), row) is None
    sub = In("x", "t", "v")
    for s, found in ((set(), False), ({3}, True), ({4}, False), ({4, None}, None), ({3, None}, True)):
        assert evaluate(sub, row, lambda _, s=s: s) is found
        assert evaluate(In("x", "t", "v", None, True), row, lambda _, s=s: s) is (None if found is None else not found)
    assert evaluate(In("n", "t", "v"), row, lambda _: {1}) is None and evaluate(In("n", "t", "v"), row, lambda _: set()) is False


def test_like_has_no_escape():
    assert like("a.c", "a.c") and not like("abc", "a.c") and like("a\\xb", "a\\_b") and like("a\nb", "a%b") and not like("A", "a")


def test_canonical_and_templates():
    a, b = Leaf("a", "eq", 1), Leaf("b", "lt", 2)
    assert canonical(And((a, b))) == canonical(And((b, a))) != canonical(Or((a, b)))
    assert canonical(In("x", "t", "v", And((a, b)))) == canonical(In("x", "t", "v", And((b, a))))
    assert equality_template(And((Leaf("b", "eq", 2), a))) == (("a", "b"), (1, 2))
    assert equality_template(And((a, Leaf("a", "eq", 2)))) is None and equality_template(Leaf("a", "eq", None)) is None and equality_template(Or((a, a))) is None
    assert subquery_template(And((b, a))) == (("a",), (1,), b)
    assert necessary_conjunct(And((b, a))) == a and necessary_conjunct(b) == b and necessary_conjunct(Or((a, b))) is None and necessary_conjunct(Not(a)) is None


def test_null_sensitive():
    leaf, negated = In("x", "t", "v"), In("x", "t", "v", None, True)
    assert not null_sensitive(leaf, leaf) and null_sensitive(Not(leaf), leaf) and null_sensitive(negated, negated) and null_sensitive(Or((IsNull("x"), negated)), negated)


def test_to_sql():
    params: list = []
    p = parse("a = 'x' AND b IN (SELECT c FROM t WHERE d = 'y') AND e > 5")
    assert to_sql(p, params) == '("a" = $1 AND "b" IN (SELECT "c" FROM "t" WHERE "d" = $2) AND "e" > 5)'
    assert params == ["x", "y"]


ROWS = [(1, "alpha", 17, True, -5.5), (2, "bravo", 18, False, 0.0), (3, None, 19, True, 100.25), (4, "", 0, False, 0.5), (5, "delta", None, True, None), (6, "alpha", 18, None, 42.0), (7, "a\\b", -3, False, -100.0)]
TEXTS = ["age < 18", "age <= 18 OR active = false", "NOT (age = 18)", "name LIKE 'al%'", "name NOT LIKE '%a'", "name LIKE 'a\\_'", "age IS NULL", "score BETWEEN -1 AND 50", "age NOT BETWEEN 1 AND 18", "name IN ('alpha', '')", "name NOT IN ('alpha')",
         "NOT (active = true AND age > 1)", "active IS NOT NULL AND (score > 0 OR name = 'delta')", "name >= 'b'", "1 = 1", "age IN (SELECT age FROM users WHERE active = true)", "age NOT IN (SELECT age FROM users WHERE active = true)",
         "age NOT IN (SELECT age FROM users WHERE id > 100)", "NOT (age IN (SELECT age FROM users WHERE id < 4)) OR name = 'alpha'", "id NOT IN (SELECT age FROM users) OR id = 1", "NOT (id NOT IN (SELECT age FROM users))"]


@pytest.mark.parametrize("text", TEXTS)
def test_plans_match_the_plain_evaluator(spark, text):
    from brooklet.operators.compile import where

    df = spark.createDataFrame(ROWS, USERS.struct())
    p = validate(parse(text), "users", {"users": USERS})
    rows = [r.asDict() for r in df.collect()]

    def values(leaf):
        return {r[leaf.project] for r in rows if matches(leaf.where, r, values)}

    expected = sorted(r["id"] for r in rows if matches(p, r, values))
    assert sorted(r["id"] for r in where(df, p, {"users": df}).collect()) == expected


def test_pushdown_reaches_the_scan(spark, tmp_path):
    from brooklet.operators.compile import shape

    spark.createDataFrame(ROWS, USERS.struct()).write.parquet(str(tmp_path / "u"))
    out = shape(spark.read.parquet(str(tmp_path / "u")), USERS, parse("age > 5"), ["name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,5)" in plan and "score" not in plan.split("ReadSchema")[1]
