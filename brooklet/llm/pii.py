"""Personal data: format-preserving Feistel pseudonyms.

Emails, telephone numbers, card numbers, IPv4 addresses, social security numbers and dates are
found by pattern, validated (Luhn sums, octets, calendar days, issued ranges) and replaced by
another value of the same format, by a keyed permutation: an alternating Feistel network of
ROUNDS double rounds over the two halves of the value, with SHA-256 of key, kind, round and the
other half as round function. Equal values get equal pseudonyms in all documents, different
values of a kind and size different ones, and a pseudonym validates as its original did:
card numbers keep their Luhn sum, dates stay days from 1900 to 2099, octets stay octets,
separators and letter cases stay where they are, emails keep their domain.

Native: column functions only. What fails validation is left as it is. Null text gives null and
no finding; empty text none; overlaps are resolved leftmost first; texts, and values in them, are
read whole whatever their length; rows may repeat; other columns pass unread.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 5
#: The setting that holds the secret key. Where it is unset a session draws a random one, so that pseudonyms
#: are linked within the session only and nobody can reverse them afterwards.
KEY_CONF = "spark.brooklet.pii.key"
KINDS = ("email", "phone", "date", "ip", "ssn", "card")
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229  # 319 * 229 = 73049 days, up to 2099-12-31

_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
#: Groups that repeat without bound are possessive: the matcher loops over them and doesn't recurse, however long the text.
PATTERN = "|".join((
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}(?:\.{_LABEL})++",
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _round(key: str, tag: Column, side: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tag, F.lit(side), i.cast("string"), other.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")


def permute(key: str, tag: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct<l, r>: the pair (left, right) of [0, a) x [0, b) under the keyed permutation."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    step = lambda s, i: _let(F.pmod(s["l"] + _number(_round(key, tag, "l", i, s["r"])), a.cast("long")), lambda l: F.struct(l.alias("l"), F.pmod(s["r"] + _number(_round(key, tag, "r", i, l)), b.cast("long")).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of 2 to 36 digits under the permutation of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    tag = F.concat(F.lit(kind), n.cast("string"))
    new = permute(key, tag, F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1).cast("long"), _power(u), _power(n - u))
    return _let(new, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0")))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("p"))
    put = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["o"], F.substr(digits, s["p"], F.lit(1))).alias("o"), (s["p"] + 1).alias("p"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["p"].alias("p")))
    return F.aggregate(_chars(template), start, put, lambda s: s["o"])


def _turn(half: Column, digest: Column) -> Column:
    """A half string with each letter and digit turned within its class by the digest's bytes."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substr(digest, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    def turned(by: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            within = lambda low, n: F.char(F.pmod(F.ascii(c) - low + F.get(by, F.pmod(k, F.lit(32))), F.lit(n)) + low)
            return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(_chars(half), one), "")

    return F.when(F.length(half) > 0, _let(bytes_, turned)).otherwise("")


def permute_name(key: str, name: Column) -> Column:
    u = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substr(name, F.lit(1), u).alias("l"), F.substr(name, u + 1).alias("r"))
    tag = F.lit("email")
    step = lambda s, i: _let(_turn(s["l"], _round(key, tag, "l", i, s["r"])), lambda l: F.struct(l.alias("l"), _turn(s["r"], _round(key, tag, "r", i, l)).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _day(m: Column) -> Column:
    """The calendar day that a date string names, or null."""
    iso = F.when(m.contains("/"), F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)))).when(m.contains("."), F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)))).otherwise(m)
    n = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(0, DAYS_A * DAYS_B - 1), n)


def _new_date(key: str, m: Column, n: Column) -> Column:
    new = _let(permute(key, F.lit("date"), F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), F.lit(DAYS_A), F.lit(DAYS_B)), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_B + s["r"]).cast("int")))
    return _let(new, lambda d: F.when(m.contains("/"), F.date_format(d, "MM/dd/yyyy")).when(m.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))


def _new_ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    join = lambda s: F.concat_ws(".", *[F.pmod(F.floor(s[h] / d), F.lit(256)).cast("string") for h in ("l", "r") for d in (256, 1)])
    return _let(o, lambda p: _let(permute(key, F.lit("ip"), p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536)), join))


def _new_ssn(key: str, d: Column) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area, group, serial = F.substr(d, F.lit(1), F.lit(3)).cast("int"), F.substr(d, F.lit(4), F.lit(2)).cast("int"), F.substr(d, F.lit(6), F.lit(4)).cast("int")
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    back = lambda s: _let(F.floor(s["l"] / 99), lambda a: F.concat(F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.pmod(s["l"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0")))
    return _let(permute(key, F.lit("ssn"), left, serial - 1, F.lit(898 * 99), F.lit(9999)), back)


def _new_card(key: str, d: Column) -> Column:
    body = permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
    check = lambda b: F.concat(b, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: F.call_function("luhn_check", F.concat(b, x)))[0])
    return _let(body, check)


def pseudonym(key: str, m: Column) -> Column:
    """struct<kind, value> of one match: its validated kind, or null, and what stands in its place."""
    out = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    same = out(None, m).cast("struct<kind: string, value: string>")
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)

    def of(d: Column) -> Column:
        issued = ~F.substr(d, F.lit(1), F.lit(3)).isin("000", "666") & (F.substr(d, F.lit(1), F.lit(1)) != "9") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6)) != "0000")
        phone = F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permute_digits(key, "phone", F.substr(d, F.length(d) - 9)))
        return (
            F.when(m.contains("@"), _let(F.substring_index(m, "@", 1), lambda n: out("email", F.concat(permute_name(key, n), F.substr(m, F.length(n) + 1)))))
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, out("ip", _new_ip(key, m))).otherwise(same))
            .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), _let(_day(m), lambda n: F.when(n.isNotNull(), out("date", _new_date(key, m, n))).otherwise(same)))
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(issued, out("ssn", refill(m, _new_ssn(key, d)))).otherwise(same))
            .when(m.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), out("phone", refill(m, phone)))
            .otherwise(F.when(F.call_function("luhn_check", d), out("card", refill(m, _new_card(key, d)))).otherwise(same))
        )

    return _let(digits, of)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with struct column ``pii``: <text, found array<struct<kind, value>>>. A column of that name
    gives way, unless it is the text."""
    raw = F.col(text)
    some = raw.rlike(r"[0-9@]")
    kept = docs.withColumns({"_pii_gaps": F.when(some, F.split(raw, PATTERN, -1)), "_pii_hits": F.when(some, F.regexp_extract_all(raw, F.lit(PATTERN), F.lit(0)))})
    kept = kept.withColumn("_pii_new", F.transform("_pii_hits", lambda m: pseudonym(key, m)))
    gaps = F.slice("_pii_gaps", F.lit(2), F.size("_pii_gaps"))
    new = F.concat(F.col("_pii_gaps")[0], F.array_join(F.zip_with("_pii_new", gaps, lambda p, g: F.concat(p["value"], g)), ""))
    found = F.filter(F.coalesce("_pii_new", F.array().cast("array<struct<kind: string, value: string>>")), lambda p: p["kind"].isNotNull())
    out = F.struct(F.when(F.size("_pii_hits") > 0, new).otherwise(raw).alias("text"), found.alias("found"))
    return kept.withColumn("pii", out).drop("_pii_gaps", "_pii_hits", "_pii_new")


def session_key(spark: SparkSession) -> str:
    if not spark.conf.get(KEY_CONF, ""):
        spark.conf.set(KEY_CONF, os.urandom(32).hex())
    return spark.conf.get(KEY_CONF)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = session_key(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    got = pseudonymise(docs, key)
    count = lambda kind: F.size(F.filter("pii.found", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[count(k) for k in KINDS], F.col("pii.text").alias("text"), F.array_join(F.transform("pii.found", lambda p: F.concat_ws(":", p["kind"], p["value"])), "\n").alias("pseudonyms"))
