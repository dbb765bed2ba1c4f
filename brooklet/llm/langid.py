"""Language identification by nearest centroid.

A text becomes a vector of hashed character trigrams (lower-cased UTF-8, anything but letters
folded to one space), weighted sqrt(tf) x idf and scaled to unit length. Every language has
several centroids, found by spherical k-means over a bounded sample of labelled rows; a text
takes the language of the centroid with the largest cosine. A text is *rejected* if it has no
letter, or if its best cosine lies under that language's threshold, a share of a low quantile of its
own rows' cosines. Short texts have lower cosines by nature: up to FULL trigrams, cosines are
measured against the square root of the length, in the fit and in the threshold alike. Rows unlike the others of
their label are left out of the fit, so that junk among the labelled rows becomes neither a centroid
nor a threshold.

Defined cases: null, empty or letterless text gives ``und`` with score 0 and is rejected;
texts of any length are read whole; ties go to the alphabetically first language; with no
labelled row to learn from every text is ``und``; rows repeat and extra columns pass freely,
because prediction is a column expression over the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed feature space, centroids of a language, and rows of the sample: of each language, and of all together.
DIMS, CENTROIDS, SAMPLE_PER_LANG, SAMPLE = 8192, 3, 400, 20_000
#: Rejected under this share of the REJECT_QUANTILE of the language's own cosines; texts of FULL trigrams
#: or more count as long. Languages that may be broadcast to pick the sample.
REJECT_SHARE, REJECT_QUANTILE, FULL, BROADCAST_LANGS = 0.25, 0.05, 256, 100_000
#: A row is like its label if the cosine with its n-th nearest row, n being LIKE_ROWS of the label's
#: sample, is at least LIKE_SHARE of the label's median.
LIKE_ROWS, LIKE_SHARE = 0.05, 0.5
UND = "und"

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_WORDISH = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(any(c.isalpha() for c in m.group()) for m in _WORDISH.finditer(text))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of a whole text, in DIMS buckets."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)
    a = _FOLD[raw].astype(np.int32)
    code = (a[:-2] * 961 + a[1:-1]) * 31 + a[2:]
    code = code[(a[:-2] != 32) | (a[1:-1] != 32)]
    code ^= code >> 7
    return np.bincount(code & (DIMS - 1), minlength=DIMS)


def expected(trigrams) -> np.ndarray:
    """What cosines of texts of that many trigrams are measured against."""
    return np.sqrt(np.minimum(1.0, trigrams / FULL))


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # index into langs of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # of each language, for long texts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        n = len(texts)
        lang, score, out = [UND] * n, np.zeros(n), [True] * n
        live = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        for at in range(0, len(live), 128):
            part = live[at : at + 128]
            counts = [trigram_counts(texts[i]) for i in part]
            x = np.sqrt(np.stack(counts)).astype(np.float32) * self.idf
            norm = np.linalg.norm(x, axis=1)
            cos = (x @ self.centroids.T) / np.maximum(norm, 1e-9)[:, None]
            best = cos.argmax(axis=1)
            for i, j, c, t in zip(part, best, cos[np.arange(len(part)), best], counts, strict=True):
                lang[i], score[i] = self.langs[self.owner[j]], round(float(min(1.0, max(0.0, c))), 6)
                out[i] = bool(c < self.reject_below[self.owner[j]] * expected(t.sum()))
        return lang, score, out


def _sphere_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with a farthest-first start; the same rows give the same centroids."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _alike(x: np.ndarray) -> np.ndarray:
    """Which rows of one label have enough others near them."""
    if len(x) < 3:
        return np.ones(len(x), dtype=bool)
    cos = x @ x.T
    np.fill_diagonal(cos, -1)
    near = -np.partition(-cos, (n := int(np.ceil(LIKE_ROWS * len(x)))) - 1, axis=1)[:, n - 1]
    return near >= LIKE_SHARE * np.median(near)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, sample: int = SAMPLE) -> Model:
    """Learn from rows with a text and a language. The sample is about ``per_lang`` rows of each
    language, or an equal part of ``sample`` rows for each if there are many, picked by a hash of
    ``key``; only its count vectors (DIMS buckets at most, whatever a text's length) reach the driver."""
    none = Model([], np.zeros(0, int), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(0))
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).filter("t is not null and l is not null and l != 'und'")
    counts = common.Scratch(labelled.sparkSession, "langid").cut(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "languages")
    if not (langs_found := counts.count()):
        return none
    share = F.ceil((1 << 40) * min(float(per_lang), sample / langs_found) / F.col("n"))
    # hash in two steps, for small ids hash alike otherwise over rows that an id filter chose
    picked = rows.join(common.if_small(counts, langs_found, BROADCAST_LANGS), "l").filter(F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 40)) < share)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in common.releasing(batches):
            kept = [(l, trigram_counts(t)) for l, t in zip(b["l"], b["t"], strict=True) if has_letter(t)]
            cols = {"l": [l for l, _ in kept], "i": [np.flatnonzero(c) for _, c in kept], "c": [c[c > 0] for _, c in kept]}
            yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in cols.items()})

    common.small_batches(labelled.sparkSession)
    got = picked.select("l", "t").mapInPandas(sparse, "l string, i array<int>, c array<int>").toPandas()
    if got.empty:
        return none
    labels, at, cs = got["l"].to_numpy(dtype=object), [np.asarray(i, dtype=np.int64) for i in got["i"]], [np.asarray(c, dtype=np.float64) for c in got["c"]]
    sizes = np.array([c.sum() for c in cs])
    order = np.lexsort([[float((i * c).sum()) for i, c in zip(at, cs, strict=True)], sizes, labels.astype(str)])  # arrival order doesn't count
    held = np.bincount(np.concatenate(at), minlength=DIMS)
    idf = (np.log((1 + len(cs)) / (1 + held)) + 1).astype(np.float32)
    langs, parts, below = sorted(set(labels)), [], []
    for l in langs:
        mine = order[labels[order] == l]
        x = np.zeros((len(mine), DIMS), dtype=np.float32)
        for r, m in enumerate(mine):
            x[r, at[m]] = np.sqrt(cs[m])
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        alike = _alike(x)
        parts.append(_sphere_means(x[alike], CENTROIDS))
        own = (x[alike] @ parts[-1].T).max(axis=1) / np.maximum(expected(sizes[mine][alike]), 1e-9)
        below.append(REJECT_SHARE * float(np.quantile(own, REJECT_QUANTILE)))
    cents = np.concatenate(parts).astype(np.float32)
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    return Model(langs, owner, cents, idf, np.array(below))


def predict(model: Model, text: Column) -> Column:
    """struct<lang, score, rejected> of a text column."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in common.releasing(batches):
            lang, score, out = model.predict(s.tolist())
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": out})

    return run.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    got = docs.select("doc_id", predict(model, F.col("text")).alias("p"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model rejects; every column passes unchanged."""
    common.small_batches(spark)
    model = fit(docs)
    name = "_brooklet_lang"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, predict(model, F.col("text"))).filter(~F.col(f"{name}.rejected")).select(*docs.columns)
