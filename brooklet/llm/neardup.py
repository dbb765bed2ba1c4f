"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join.

A document's set is its distinct w-word shingles (A-Z lower-cased, words split at ASCII white
space; fewer than w words: the whole sequence as one). Its signature is K MinHash symbols, cut
into CHUNKS chunks. Two signatures that differ in at most T = ERRORS symbols have, by
pigeonhole, a chunk with at most T // CHUNKS = 1 differing symbol; each chunk therefore gives
one key per symbol left out, and every pair within T meets under some key. At a similarity of
0.8 a pair differs in 9.6 of 48 symbols on average, and in more than T = 23 with a probability
of about 7e-6. Keys hash 16 bits a symbol; the distance of two signatures is counted on 4 bits
a symbol, which can only lower it. Candidates are confirmed on the full sets.

Steps: documents with equal sets are one class, named by its smallest doc_id; only classes go
on. Keys held by one class are dropped at once. Then, in TURNS rounds, the members of a key
meet its leader (an aggregation, combined before its shuffle), never each other; confirmed
pairs give components, and a key whose members are all in one component is settled and
dropped. The first leader is the member with the most company over all its keys, which in a
group of copies is the text that they were copied from; later ones change with the round. For
the keys that remain, the pairs from different components, of compatible sizes and within T,
are confirmed: no pair is capped, dropped or sampled. Most of them are told apart without being
made: each document that has a possible partner gets a bitmap of its set's hashes, and a bit
that only one of two documents has is a shingle that the other lacks, which bounds what they
share, and so their similarity, exactly. In a group of copies that were changed a little too
much to be linked, this leaves next to no pair.

Rows of one key, leader or digest beyond common.HOT are dealt over several tasks (join_dealt). Not
dealt are repeated rows of one doc_id with one text, which differ in nothing: Spark's skew handling
has to split those.

Defined cases: null, empty or blank text has an empty set, linked with nothing; a null doc_id
takes no part, has a null component and is kept; rows that repeat a doc_id are one document, linked
by any of its texts and with one component (each row has its own n_shingles); an empty table gives
no rows; extra columns are not read. Classes that share their smallest doc_id share their name:
they are one document's texts, so a link of either is a link of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

K, CHUNKS, ERRORS, TURNS = 48, 12, 23, 3
WIDTH = K // CHUNKS
#: Words of 64 bits that hold the signature's low 4 bits a symbol.
PACKED = K // 16
#: Words of 64 bits in the bitmap of a set; members of a key up to which its pairs are joined, and
#: members of one block of a larger key.
BITMAP, SMALL_KEY, BLOCK = 64, 32, 1024
#: Ids up to this many are broadcast to fetch texts, and classes (about 60 bytes each) to fetch
#: signatures; beyond, those joins shuffle.
BROADCAST_IDS, BROADCAST_CLASSES = 1_000_000, 600_000
#: Words that a worker remembers the hash of; beyond, the memory starts anew.
_CACHE_WORDS = 200_000
_words: dict[bytes, int] = {}
_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, w: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > _CACHE_WORDS:
        _words.clear()
    for word in {*words}.difference(_words):
        _words[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - w + 1)
    s = np.full(n, np.uint64(min(w, len(h))), dtype=np.uint64)
    for j in range(min(w, len(h))):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """K symbols of 16 bits."""
    low = np.full(K, _FULL, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    return (_mix(low) & np.uint64(0xFFFF)).astype(np.int32)


def _signed(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(4) * np.arange(16, dtype=np.uint64)
    for b in common.releasing(batches, _words.clear):
        n, d1, d2, packed, sig = [], [], [], [[] for _ in range(PACKED)], []
        for t in b.column(1).to_pylist():
            s = shingle_set(t, w)
            n.append(len(s))
            if not len(s):
                for col in (d1, d2, sig, *packed):
                    col.append(None)
                continue
            dig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            d1.append(int.from_bytes(dig[:8], "little", signed=True)), d2.append(int.from_bytes(dig[8:], "little", signed=True))
            g = signature(s)
            low = ((g & 15).astype(np.uint64).reshape(PACKED, 16) << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
            for col, x in zip(packed, low.tolist(), strict=True):
                col.append(x)
            sig.append(g)
        longs = [pa.array(x, pa.int64()) for x in (n, d1, d2, *packed)]
        yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n", "d1", "d2", *_PACKED, "sig"])


_PACKED = [f"p{i}" for i in range(PACKED)]
_SIGNED = "doc_id long, n long, d1 long, d2 long, " + "".join(f"{p} long, " for p in _PACKED) + "sig array<int>"


def _sets(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[pa.RecordBatch]:
    for b in common.releasing(batches, _words.clear):
        got = [shingle_set(t, w).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["id", "s"])


def _bitmaps(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[pa.RecordBatch]:
    for b in common.releasing(batches, _words.clear):
        maps = []
        for t in b.column(1).to_pylist():
            on = np.zeros(64 * BITMAP, dtype=np.uint8)
            on[shingle_set(t, w) & np.uint64(64 * BITMAP - 1)] = 1
            maps.append(np.packbits(on).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.list_(pa.int64()))], ["id", "bits"])


def _keys(classes: DataFrame) -> DataFrame:
    """One row per class and key: the symbols of each chunk but one."""
    each = [F.xxhash64(F.lit(c * WIDTH + out), *[F.col("sig")[c * WIDTH + j] for j in range(WIDTH) if j != out]) for c in range(CHUNKS) for out in range(WIDTH)]
    return classes.select("id", F.explode(F.array(*each)).alias("key"))


def _fits(a: str, b: str) -> str:
    """Whether sizes and signatures are those of a possible pair."""
    x = [f"({a}.{p} ^ {b}.{p})" for p in _PACKED]
    # a symbol differs if any of its four bits does: fold them onto the lowest, and count
    differ = " + ".join(f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & {0x1111111111111111})" for v in x)
    return f"100 * least({a}.n, {b}.n) >= 80 * greatest({a}.n, {b}.n) and {differ} <= {ERRORS}"


def _pair(a: str, b: str) -> list:
    return [F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")]


def _confirm(scratch: common.Scratch, docs: DataFrame, pairs: DataFrame, w: int) -> DataFrame:
    """The pairs (u, v) with an exact similarity of 0.8 or more. Texts of the documents that
    stand in a pair are read again; only those."""
    spark = docs.sparkSession
    ids = scratch.cut(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "ids")
    few = common.if_small(ids, ids.count(), BROADCAST_IDS)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(few, "id", "left_semi")
    sets = scratch.cut(texts.mapInArrow(lambda b: _sets(b, w), "id long, s array<long>").distinct(), "sets")
    one = common.join_dealt(scratch, pairs, sets.select(F.col("id").alias("u"), F.col("s").alias("su")), ["u"], ["v"], common.hot_values(pairs, "u"))
    two = common.join_dealt(scratch, one, sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), ["v"], ["u"], common.hot_values(pairs, "v"))
    both = F.size(F.array_intersect("su", "sv"))
    out = scratch.cut(two.withColumn("i", both).filter("100 * i >= 80 * (size(su) + size(sv) - i)").select("u", "v").distinct(), "links")
    scratch.drop(ids, sets)
    return out


def _within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one pair of blocks: from different components, of compatible sizes, within T, and
    similar as far as their bitmaps tell. A bit that only one document has is a shingle that the
    other lacks, so each lacks at least as many as the other has bits of its own."""
    _, i, j = key
    pdf = pdf.sort_values("id", kind="stable")
    ids, n, comp = (pdf[c].to_numpy() for c in ("id", "n", "comp"))
    packed = pdf[_PACKED].to_numpy().view(np.uint64)
    bits = np.vstack(pdf["bits"].to_numpy()).view(np.uint64)
    here = pdf["block"].to_numpy() == i
    low = np.uint64(0x1111111111111111)
    us, vs = [], []
    for a in np.flatnonzero(here):
        b = np.flatnonzero((comp != comp[a]) & (100 * np.minimum(n, n[a]) >= 80 * np.maximum(n, n[a])) & ((ids > ids[a]) if i == j else ~here))
        x = packed[b] ^ packed[a]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        b = b[np.bitwise_count(x & low).sum(axis=1) <= ERRORS]
        shared = np.bitwise_count(bits[b] & bits[a]).sum(axis=1)
        most = np.minimum(n[a] - (np.bitwise_count(bits[a]).sum(dtype=np.int64) - shared), n[b] - (np.bitwise_count(bits[b]).sum(axis=1, dtype=np.int64) - shared))
        b = b[180 * most >= 80 * (n[a] + n[b])]
        us += np.maximum(ids[b], ids[a]).tolist()
        vs += np.minimum(ids[b], ids[a]).tolist()
    return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})


def _hot_keys(members: DataFrame) -> DataFrame:
    """The keys that more than HOT members hold, with that count."""
    return members.filter(F.col("c") > common.HOT).groupBy("key").agg(F.max("c").alias("c"))


def _led(scratch: common.Scratch, members: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """Pairs of each key's members and leader; whom a key takes for its leader changes with the turn."""
    if turn == 0:
        lead = members.groupBy("key").agg(F.max_by("id", "company").alias("leader"))
    elif turn == 1:
        lead = members.groupBy("key").agg(F.min("id").alias("leader"))
    else:
        lead = members.groupBy("key").agg(F.max_by("id", F.xxhash64(F.lit(turn), "id")).alias("leader"))
    a, b = classes.alias("a"), classes.alias("b")
    # a leader leads no more keys than a text has, so its signature is joined to keys, not to pairs
    lead = lead.join(b, F.expr("leader = b.id")).select("key", "leader", *[F.col(f"b.{c}").alias(f"_{c}") for c in ("n", *_PACKED)])
    met = common.join_dealt(scratch, members.select("id", "key"), lead, ["key"], ["id"], _hot_keys(members)).filter("id != leader")
    b = met.select("id", "leader", *[F.col(f"_{c}").alias(c) for c in ("n", *_PACKED)]).alias("b")
    return b.join(a, F.expr("a.id = b.id")).filter(_fits("a", "b")).select(*_pair("b.id", "b.leader")).distinct()


def _rest(scratch: common.Scratch, docs: DataFrame, members: DataFrame, classes: DataFrame, w: int) -> DataFrame:
    """Every pair (u, v) of members of one key, from different components, that may be similar."""
    sized = members.select("id", "key", "comp").join(classes, "id")
    a, b = sized.alias("a"), sized.alias("b")
    # who has a possible partner at all: one row for each member, not for each pair
    near = scratch.cut(a.join(b, F.expr("a.key = b.key and a.comp != b.comp and " + _fits("a", "b")), "left_semi").select("id").distinct(), "near")
    few = common.if_small(near, near.count(), BROADCAST_IDS)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(few, "id", "left_semi")
    maps = scratch.cut(texts.mapInArrow(lambda b: _bitmaps(b, w), "id long, bits array<long>").distinct(), "bitmaps")
    left = scratch.cut(sized.join(maps.select("id"), "id", "left_semi").distinct(), "left")
    held = scratch.cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "held")
    a, b = left.join(held.filter(f"c <= {SMALL_KEY}"), "key").alias("a"), left.alias("b")
    small = a.join(b, F.expr("a.key = b.key and b.comp < a.comp and " + _fits("a", "b"))).select(*_pair("a.id", "b.id"))
    # a larger key is dealt out in blocks, and each pair of blocks is one group
    n = F.ceil(F.col("c") / BLOCK).cast("int")
    large = common.join_dealt(scratch, left, held.filter(f"c > {SMALL_KEY}"), ["key"], ["id"], held.filter(F.col("c") > common.HOT)).join(maps, "id").withColumns({"blocks": n, "block": F.pmod(F.xxhash64(F.lit("block"), "id"), n).cast("int")})
    cells = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = cells.select("key", "i", "j", "block", "id", "n", "comp", *_PACKED, "bits").groupBy("key", "i", "j").applyInPandas(_within, "u long, v long")
    return scratch.cut(small.union(found).distinct(), "rest")


def _one_document(named: DataFrame, first: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of doc_ids that repeat with different texts."""
    texts = named.select("doc_id", "d1", "d2").distinct()
    several = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    held = texts.join(several, "doc_id").join(first, ["d1", "d2"]).select("doc_id", "id").distinct()
    apart = held.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("most")).filter("v < most").select("doc_id", "v")
    return held.join(apart, "doc_id").filter("id != v").select(F.col("id").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, w: int = 5, scratch: common.Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = scratch or common.Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.cut(docs.mapInArrow(lambda b: _signed(b, w), _SIGNED), "signed")
    named = signed.filter("doc_id is not null and d1 is not null")
    first = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    every = scratch.cut(named.withColumnRenamed("doc_id", "id").join(first, ["id", "d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"]).select("id", "d1", "d2", "n", *_PACKED, "sig"), "classes")
    classes = common.if_small(every.select("id", "n", *_PACKED), every.count(), BROADCAST_CLASSES)

    # keys that several classes hold; one pass to count, one to take their members
    keys = _keys(every)
    shared = scratch.cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    members = scratch.cut(common.join_dealt(scratch, keys, shared, ["key"], ["id"], shared.filter(F.col("c") > common.HOT)), "members")
    company = members.groupBy("id").agg(F.sum("c").alias("company"))
    members = scratch.cut(members.join(company, "id"), "company")
    comp, links = None, scratch.cut(_one_document(named, first), "links")
    for turn in range(TURNS):
        new = _led(scratch, members, classes, turn)
        new = scratch.cut(new.join(links, ["u", "v"], "left_anti"), "candidates")
        links = scratch.cut(links.union(_confirm(scratch, docs, new, w)), "links")
        comp = scratch.cut(components(scratch, links), "components")
        placed = members.select("id", "key", "c").join(comp.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").select("id", "key", "c", F.coalesce("comp", "id").alias("comp"))
        opened = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("most")).filter("lo < hi and most > 2").select("key")
        members = scratch.cut(common.join_dealt(scratch, placed, opened, ["key"], ["id"], _hot_keys(members)), "open")
        if members.isEmpty():
            break

    rest = _rest(scratch, docs, members, classes, w)
    if not rest.isEmpty():
        links = scratch.cut(links.union(_confirm(scratch, docs, rest, w)), "links")
        comp = scratch.cut(components(scratch, links), "components")
    ids = every.join(comp, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    out = common.join_dealt(scratch, rows, ids, ["d1", "d2"], ["doc_id"], common.hot_values(rows, "d1", "d2"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), w=2)


#: All pairs that share a shingle, and what is reachable over the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), link AS (
  SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.s = y.s AND x.r < y.r JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r
  WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY x.r, y.r, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
  UNION SELECT x.r, y.r FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.r < y.r
), ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b
), c AS (SELECT reach.a AS r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN w.doc_id IS NOT NULL THEN component_id END AS component_id, coalesce(w.doc_id = component_id, TRUE) AS kept
FROM w JOIN c ON c.r = w.r LEFT JOIN n ON n.r = w.r
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, 0.8): the smallest doc_id."""
    found = near_duplicates(docs, w=5)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = common.Scratch(spark, "neardup-gone").cut(gone, "gone")
    few = common.if_small(gone, gone.count(), BROADCAST_IDS)
    return docs.join(few, docs["doc_id"] == few["_gone"], "left_anti").select(*[docs[c] for c in docs.columns])
