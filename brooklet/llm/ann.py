"""Approximate nearest neighbours by cosine: an inverted-list index whose lists are searched
with an adaptive dimension scan.

Vectors are scaled to length 1 and turned by a fixed random rotation, so that any prefix of the
turned components estimates the whole distance. Within a probed list, a query reads candidates
in column blocks of COLUMNS; after d of D components, a candidate whose scaled partial
distance exceeds the query's limit by more than the factor 1 + EPSILON / sqrt(d) is, under
that hypothesis test, abandoned and its other components are never read. What is left is
scored exactly, in double precision, on the original vectors.

The limit is the query's k-th best distance so far. It is first found in the query's own nearest
list (and the next ones, until they hold FIRST candidates), and starts the scan of every other
list, which tightens it further as its parts of PART rows are read.

Which other lists a query probes follows from that limit, too: from a list's centre, its members'
cosines with the centre and the spread of members around centres comes how many of its members may
be expected to be nearer than the limit; lists are taken, most promising first, until SHARE of all
that is expected is covered. Clustered vectors need a few lists of any number; vectors without
structure need most of them, for their neighbours are everywhere.

Centres are fitted on at most SAMPLE vectors; every vector is indexed. Lists are dealt out in blocks
of about BLOCK rows, and the queries that probe a list in blocks of about QUERY_BLOCK, so a list that
holds a third of all vectors is many tasks' work, and a list is copied only for its own queries.

Defined cases: vectors that are null, empty, zero, of another length than the most frequent
one, or hold null or non-finite components take no part, as queries or candidates; a null id
takes no part; ties go to the smaller id; equal vectors all compete; an id that repeats is one
row, with the smallest of its vectors; an empty table gives no rows; extra columns are not read;
components may have any magnitude (vectors are scaled by powers of two before they are squared).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SAMPLE, ROUNDS, MOST_LISTS = 20_000, 10, 2048
#: Candidates of a query's first lists, and the part of all expected near vectors that the probed lists hold.
FIRST, SHARE = 64, 0.96
BLOCK, QUERY_BLOCK, PART, COLUMNS, EPSILON = 4096, 8192, 1024, 16, 2.1
#: Queries scanned together, and the share of pairs left under which they are followed one by one.
TOGETHER, FEW = 128, 0.25
SLACK = 1e-4


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    c = x[np.random.default_rng(11).choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS if lists > 1 else 0):
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(lists))
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), starts, axis=0)
        sums[np.bincount(own, minlength=lists) == 0] = 0
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def spread(x: np.ndarray, c: np.ndarray) -> float:
    """The variance of the cosine between what a vector and a member of its second nearest list have
    besides that list's centre."""
    if len(c) < 2:
        return 1.0
    order = np.argsort(-(x @ c.T), axis=1, kind="stable")
    members = np.argsort(order[:, 0], kind="stable")
    held = np.bincount(order[:, 0], minlength=len(c))
    some = np.flatnonzero(held[order[:, 1]])
    second = order[some, 1]
    picked = (np.random.default_rng(13).random(len(some)) * held[second]).astype(int)
    other, centre = x[members[(np.cumsum(held) - held)[second] + picked]], c[second]
    a, b = (x[some] * centre).sum(axis=1), (other * centre).sum(axis=1)
    aside = (1 - a**2).clip(0) * (1 - b**2).clip(0)
    dots = ((x[some] * other).sum(axis=1) - a * b)[aside > 1e-9] ** 2 / aside[aside > 1e-9]
    return float(max(dots.mean(), 1.0 / x.shape[1])) if len(dots) else 1.0


def tail(x: np.ndarray) -> np.ndarray:
    """About the share of a normal distribution beyond x."""
    half = 0.5 * np.exp(-0.717 * np.abs(x) - 0.416 * x * x)
    return np.where(x >= 0, half, 1 - half)


def exact(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, in double precision, each summed in the same order."""
    a, q = scaled(a), scaled(q)
    return (a * q).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def scan(y: np.ndarray, z: np.ndarray, limit: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of turned candidates y and queries z that may be among a query's k
    nearest. ``limit`` is each query's squared distance to beat, ``same`` marks its own row."""
    dim, limit = y.shape[1], limit.copy()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(y), PART):
        part = y[low : low + PART]
        alive = ~same[:, low : low + PART]
        far, rows, cols, near = np.zeros(alive.shape, dtype=np.float32), None, None, None
        for at in range(0, dim, COLUMNS):
            end = min(dim, at + COLUMNS)
            p, q = part[:, at:end], z[:, at:end]
            bound = limit * (1 + (EPSILON / end**0.5 if end < dim else 0)) ** 2 + SLACK
            if rows is None:
                far += (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (q @ p.T)
                alive &= far * (dim / end) <= bound[:, None]
                if end < dim and alive.mean() < FEW:
                    rows, cols = np.nonzero(alive)
                    near = far[rows, cols]
            elif len(rows):
                near = near + ((p[cols] - q[rows]) ** 2).sum(axis=1)
                keep = near * (dim / end) <= bound[rows]
                rows, cols, near = rows[keep], cols[keep], near[keep]
        if rows is None:
            rows, cols = np.nonzero(alive)
            near = far[rows, cols]
        if not len(rows):
            continue
        kept.append((rows, cols + low, near))
        # the limits tighten: a query's k-th best of what it has so far
        r, d = np.concatenate([x[0] for x in kept]), np.concatenate([x[2] for x in kept])
        c = np.concatenate([x[1] for x in kept])
        order = np.lexsort((d, r))
        r, c, d = r[order], c[order], d[order]
        start = np.searchsorted(r, np.arange(len(z)))
        full = np.flatnonzero(np.bincount(r, minlength=len(z)) >= k)
        limit[full] = np.minimum(limit[full], d[start[full] + k - 1])
        keep = d <= limit[r] + SLACK
        kept = [(r[keep], c[keep], d[keep])]
    return (kept[0][0], kept[0][1]) if kept else (np.zeros(0, int), np.zeros(0, int))


def _vectors(col) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _parts(vectors: DataFrame) -> DataFrame:
    """The vectors that take part, as (id, v array<double>)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    dim = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("v") == dim[0]["n"]).groupBy("id").agg(F.min("v").alias("v")) if dim else v


def _top(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probe(asked: DataFrame, indexed: DataFrame, blocks: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest within each block of each list, of queries
    asked(id, v, list, worst), ``worst`` being the cosine that they have to beat."""
    by_list = np.zeros(len(blocks), dtype=np.int64)
    for r in asked.groupBy("list").count().collect():
        by_list[r["list"]] = r["count"]
    of = lambda counts: F.get(F.array(*[F.lit(int(n)) for n in counts]), F.col("list"))
    dealt = lambda what, counts: F.pmod(F.xxhash64(F.lit(what), "id"), of(counts)).cast("int")
    each = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    q_blocks, keys = -(-by_list // QUERY_BLOCK), ["list", "block", "qb"]
    cand = indexed.filter(of(q_blocks) > 0).withColumn("block", dealt("block", blocks)).withColumn("qb", each(q_blocks)).select(*keys, "id", "v")
    asked = asked.withColumn("qb", dealt("query", q_blocks)).withColumn("block", each(blocks)).select(*keys, "id", "v", "worst")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if len(left) and len(right):
            ids, x = left["id"].to_numpy(), _vectors(left["v"])
            y = (unit(x) @ turn).astype(np.float32)
            for at in range(0, len(right), TOGETHER):
                some = right.iloc[at : at + TOGETHER]
                qs, q_ids = _vectors(some["v"]), some["id"].to_numpy()
                limit = (2 - 2 * some["worst"].to_numpy()).astype(np.float32)
                q, c = scan(y, (unit(qs) @ turn).astype(np.float32), limit, q_ids[:, None] == ids, k)
                score = np.concatenate([np.zeros(0), *(exact(x[c[i : i + 4096]], qs[q[i : i + 4096]]) for i in range(0, len(c), 4096))])
                order = np.lexsort((ids[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                for name, col in (("query_id", q_ids[q]), ("vec_id", ids[c]), ("score", score)):
                    out[name].append(col[best])
        return pd.DataFrame({n: np.concatenate(v) for n, v in out.items()})

    return cand.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    scratch = common.Scratch(spark, "ann")
    parts = scratch.cut(_parts(vectors), "parts")
    total = parts.count()
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE * 0.9 / total)
    few = parts.filter(F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(SAMPLE).toPandas()["v"]
    sample = unit(_vectors(few)) if len(few) else unit(_vectors(parts.select("v").limit(1).toPandas()["v"]))
    lists = min(MOST_LISTS, max(1, round(total**0.5 / 2)), len(sample))
    c = centres(sample, lists)
    sigma, turn = spread(sample, c) ** 0.5, rotation(sample.shape[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = unit(np.array(b.column(1).to_pylist(), dtype=np.float64)) @ c.T
                own = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(cos[np.arange(len(own)), own])], ["id", "v", "list", "cos"])

    indexed = scratch.cut(parts.mapInArrow(assign, "id long, v array<double>, list int, cos double"), "indexed")
    sizes, cosines = np.zeros(lists, dtype=np.int64), np.zeros(lists)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("cos")).collect():
        sizes[r["list"]], cosines[r["list"]] = r["n"], min(1.0, r["cos"])
    blocks = -(-sizes // BLOCK)
    queries = parts.filter(F.col("id") % every == 0)
    probed = "id long, v array<double>, worst double, lists array<int>"

    def first_lists(cos: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(-cos, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        return [o[: int(np.searchsorted(h, max(FIRST, k + 1))) + 1] for o, h in zip(order, held, strict=True)]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = first_lists(unit(np.array(b.column(1).to_pylist(), dtype=np.float64)) @ c.T)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, -2.0)), pa.array([x.tolist() for x in near], pa.list_(pa.int32()))], ["id", "v", "worst", "lists"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cos, worst = unit(np.array(b.column(1).to_pylist(), dtype=np.float64)) @ c.T, b.column(2).to_numpy()
            aside = np.sqrt(np.maximum(1e-12, (1 - cos**2).clip(0) * (1 - cosines**2))) * sigma
            hoped = sizes * tail((worst[:, None] - cos * cosines) / aside)
            got = []
            for near, h in zip(first_lists(cos), hoped, strict=True):
                total_hope, seen = h.sum(), h[near].sum()
                h = h.copy()
                h[near] = -1
                order = np.argsort(-h, kind="stable")[: lists - len(near)]
                need = int(np.searchsorted(np.cumsum(h[order]) + seen, SHARE * total_hope)) + 1 if seen < SHARE * total_hope else 0
                got.append(order[:need].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.list_(pa.int32()))], ["id", "v", "worst", "lists"])

    each = lambda probes: scratch.cut(probes.select("id", "v", "worst", F.explode("lists").alias("list")), "asked")
    first = scratch.cut(_top(_probe(each(queries.mapInArrow(start, probed)), indexed, blocks, turn, k), k), "first")
    worst = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
    known = queries.join(worst, "id", "left").select("id", "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    more = _probe(each(known.mapInArrow(go_on, probed)), indexed, blocks, turn, k)
    return _top(more.union(first.select("query_id", "vec_id", "score")), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), every=50, k=5)
