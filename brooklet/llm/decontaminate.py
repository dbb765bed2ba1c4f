"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A benchmark item's set is its distinct five-word shingles (lower-cased, words are runs of
letters and digits; fewer than five words: the whole sequence as one). A document is
contaminated by an item if it holds at least 80 % of the item's set, wherever in its text.

Items are partitioned by the size of their sets. An item that misses at most m = n - ceil(0.8 n) of
its n shingles is represented by its bottom-k MinHash sketch, the k smallest shingle hashes, with
k = 2 m + 1 from the partition's largest size: a document that holds 80 % of an item misses at
most m of any k of its shingles, so one that holds fewer than k - m sketch values is out for
certain: the search has no false negative, however long the document (a signature of the whole
document would lose short items in long ones). Documents stream past the sketches; the (document,
item) pairs that pass are candidates, and only their texts are read again, to count the item's
shingles, as words and not as hashes, over the whole text. An item under five words is one short
sequence, and so is found only in documents of exactly those words.

Native: DataFrame functions only. The sketches are broadcast only if they were counted within
BROADCAST_ROWS; beyond that the same join shuffles. Defined cases: null or empty texts have no
shingle and match nothing; items without shingles match nothing; equal items each match; rows
repeating a doc_id are one document that holds what any of them holds; a null doc_id takes no part and
stays; a repeated item_id is one item, the union of its rows' shingles; an empty benchmark contaminates
nothing; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

W, SHARE_NUM, SHARE_DEN = 5, 4, 5
#: Rows of sketches or candidates (two numbers or three) and items with their texts that may be broadcast.
BROADCAST_ROWS, BROADCAST_ITEMS = 2_000_000, 20_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _starts(ws: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(ws) - W, F.lit(0)))


def shingles(text: Column) -> Column:
    """Distinct shingles of a text, as words; null without words."""
    each = lambda ws: F.when(F.size(ws) > 0, F.array_distinct(F.transform(_starts(ws), lambda i: F.array_join(F.slice(ws, i + 1, W), " "))))
    return F.transform(F.array(_words(text)), each)[0]


def hashes(text: Column) -> Column:
    """A hash for each shingle of a text, in their order, repeats included; null without words. Words
    are hashed once, and shingles from their words' hashes."""
    of = lambda hs, i: F.xxhash64(*[F.get(hs, i + j) for j in range(W)])
    each = lambda hs: F.when(F.size(hs) > 0, F.transform(_starts(hs), lambda i: of(hs, i)))
    return F.transform(F.array(F.transform(_words(text), lambda w: F.xxhash64(w))), each)[0]


def item_sketches(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, n, s) with all shingles of each item, and (item_id, need, h): its sketch values and
    how many of them a document must hold."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingles(F.col("text")).alias("s")).filter("s is not null and item_id is not null")
    items = rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")).select("item_id", F.size("s").alias("n"), "s")
    missed = lambda n: n - F.ceil(n * SHARE_NUM / SHARE_DEN)
    hashed = items.select("item_id", "n", F.floor(F.log2("n")).alias("part"), F.array_sort(F.array_distinct(F.transform("s", _hash_of_shingle))).alias("hs"))
    top = hashed.groupBy("part").agg(F.max("n").alias("most"))
    sized = hashed.join(top, "part").withColumn("k", F.least(F.size("hs"), 2 * missed(F.col("most")) + 1).cast("int"))
    return items, sized.select("item_id", F.greatest(F.col("k") - missed(F.col("n")), F.lit(1)).alias("need"), F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def _hash_of_shingle(s: Column) -> Column:
    """The hash that hashes() gives a shingle."""
    hs = F.transform(F.split(s, " "), lambda w: F.xxhash64(w))
    return F.transform(F.array(hs), lambda x: F.xxhash64(*[F.get(x, F.lit(j)) for j in range(W)]))[0]


def candidates(docs: DataFrame, sketch: DataFrame, rows: int) -> DataFrame:
    """(doc_id, item_id) that hold enough sketch values; the sketch table has ``rows`` rows."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(F.col("text")).alias("hs")).filter("doc_id is not null and hs is not null")
    met = hashed.select("doc_id", F.explode("hs").alias("h")).join(common.if_small(sketch, rows, BROADCAST_ROWS), "h")
    held = met.groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("c"))
    return held.filter("c >= need").select("doc_id", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of every document that holds an item."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "decontaminate")
    items, sketch = item_sketches(benchmark)
    items, sketch = scratch.cut(items, "items"), scratch.cut(sketch, "sketches")
    pairs = scratch.cut(candidates(docs, sketch, sketch.count()), "candidates")
    # exact containment: whole texts again, but of candidates only
    few = common.if_small(pairs, pairs.count(), BROADCAST_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id", "left_semi")
    read = texts.select("doc_id", shingles(F.col("text")).alias("g")).filter("g is not null").join(few, "doc_id")
    whole = common.if_small(items, items.count(), BROADCAST_ITEMS)
    both = read.join(whole, "item_id").select("doc_id", "item_id", "n", F.explode(F.array_intersect("g", "s")).alias("g"))
    counted = both.distinct().groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter(f"{SHARE_DEN} * shared >= {SHARE_NUM} * n").select("doc_id", "item_id", "shared", F.col("n").cast("long").alias("item_shingles"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of items it holds, the smallest of them, and whether it stays."""
    docs = common.read(spark, sf_dir, "documents")
    found = contaminated(docs, common.read(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"))
    out = docs.select("doc_id").join(found.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("items", F.lit("")).alias("items"), F.col("n_items").isNull().alias("kept"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id AS id, 0 AS kind, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents
  UNION ALL
  SELECT item_id, 1, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] FROM benchmark
), shingle AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), items AS (SELECT id, count(*) AS n FROM shingle WHERE kind = 1 GROUP BY id
), pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM shingle b JOIN shingle d ON d.s = b.s AND d.kind = 0 WHERE b.kind = 1 GROUP BY 1, 2
), found AS (
  SELECT doc_id, count(*) AS n_items, min(item_id) AS item_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items
  FROM pairs JOIN items ON items.id = pairs.item_id WHERE 5 * shared >= 4 * n GROUP BY doc_id
)
SELECT d.doc_id, coalesce(f.n_items, 0) AS n_items, f.item_id, coalesce(f.items, '') AS items, f.doc_id IS NULL AS kept
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; every column passes unchanged."""
    gone = contaminated(docs, common.read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = common.Scratch(spark, "decontaminate-gone").cut(gone, "gone")
    return docs.join(common.if_small(gone, gone.count(), BROADCAST_ROWS), docs["doc_id"] == gone["_gone"], "left_anti").select(*[docs[c] for c in docs.columns])
