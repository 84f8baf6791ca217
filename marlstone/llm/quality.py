"""Quality classifier by positive-unlabelled learning with the non-negative risk.

A linear model on how a text is written: counts of bytes and of triples of character classes, and measures of
repetition. It learns from trusted positives and unlabelled web text. The risk is pi * R+(positives) plus
R-(unlabelled) - pi * R-(positives), the latter part held at zero or above. pi is the class prior, estimated from
positives and unlabelled rows alone: a first model is fitted on two thirds of the sample, and on the third it hasn't
seen pi is the least ratio, over cuts, of the unlabelled to the positive share above the cut. No negative label is used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_names, written

#: Fitting reads this many positives and this many unlabelled texts at most; everything else reads all rows.
MAX_POSITIVES = MAX_UNLABELLED = 6000
CLASSES = 8
#: Standardised features are cut off here.
CLIP = 10.0
#: Bytes at which a text's deviations count half.
SHORT = 20


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte: 0 blank, 1 line end, 2 a-z, 3 A-Z, 4 digit, 5 sentence mark, 6 other ASCII, 7 beyond ASCII."""
    t = np.full(256, 6, np.uint8)
    t[128:] = 7
    for chars, k in ((b" \t\r\x0b\x0c", 0), (b"\n", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".,;:!?'\"()-", 5)):
        t[list(chars)] = k
    return t


_CLASS = _class_table()
N_FEATURES = CLASSES**3 + 128 + 6 + 1


def features(text: str | None) -> np.ndarray:
    """Roots of shares of class triples and ASCII bytes, measures of repetition and length, last how far to trust them; zeros for no text."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    counts, triples = np.zeros(256, np.int64), np.zeros(CLASSES**3, np.int64)
    for at in range(0, len(b), 1 << 20):  # blocks keep long texts' working memory small
        block = b[max(0, at - 2) : at + (1 << 20)]
        counts += np.bincount(block[at - max(0, at - 2) :], minlength=256)
        c = _CLASS[block].astype(np.int32)
        if len(c) > 2:
            triples += np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    out[: CLASSES**3] = np.sqrt(triples / len(b))
    out[CLASSES**3 : CLASSES**3 + 128] = np.sqrt(counts[:128] / len(b))
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    squeeze = zlib.compressobj(1)
    size = len(squeeze.compress(raw)) + len(squeeze.flush())
    out[CLASSES**3 + 128 :] = (len(set(words)) / n, same / n, len(set(lines)) / len(lines), min(1.0, size / (len(raw) + 16)), np.log1p(len(words)) / 10, len(raw) / n / 20, len(raw) / (len(raw) + SHORT))
    return out


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised features, drawn to the average text's the shorter the text is."""
    return np.clip((x[:, :-1] - mean) / std, -CLIP, CLIP) * x[:, -1:]


def _feature_rows(rows: DataFrame) -> DataFrame:
    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"], "h": b["h"], "x": [features(t).tobytes() for t in b["text"]]})

    return rows.mapInPandas(rows_of, "kind int, h string, x binary")


def non_negative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-4) -> np.ndarray:
    """Weights, the intercept last, of the linear model of least non-negative PU risk with the logistic loss (Adam)."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        wrong = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        back = u.T @ sig(zu) / len(u) - prior * (p.T @ sig(zp)) / len(p)
        grad = -prior * (p.T @ sig(-zp)) / len(p) + back if wrong >= 0 else -back
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def spread_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Prior from scores alone: the least ratio of the unlabelled to the positive share above a cut that keeps a fifth of
    the positives. Above the best cut nearly all are positive, so the ratio is their share among the unlabelled."""
    cuts = np.quantile(positive, np.linspace(0, 0.8, 41))
    above = lambda x: np.array([(x >= c).mean() for c in cuts])
    return float(np.clip((above(unlabelled) / np.maximum(above(positive), 1e-9)).min(), 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior of ``unlabelled``: ``spread_prior`` on each third of the rows, scored by a model of the others; the
    mean of the three. Half where there are too few rows."""
    if min(len(positive), len(unlabelled)) < 9:
        return 0.5
    found = []
    for k in range(3):
        own = [np.arange(len(x)) % 3 == k for x in (positive, unlabelled)]
        w = non_negative_pu(positive[~own[0]], unlabelled[~own[1]], 0.5, steps=150)
        found.append(spread_prior(positive[own[0]] @ w[:-1], unlabelled[own[1]] @ w[:-1]))
    return float(np.mean(found))


def _learnt(rows: DataFrame) -> dict | None:
    """The model of the sample ``rows`` (kind, h, x), fitted in one task: their number is bounded. None without both kinds."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        sample = pd.concat(parts).sort_values(["kind", "h", "x"]).drop_duplicates(["kind", "h"])  # a repeated doc_id gives one row
        x = {k: np.stack([np.frombuffer(b, np.float32) for b in g["x"]]) for k, g in sample.groupby("kind")}
        if 1 not in x or 0 not in x:
            return
        n = sum(map(len, x.values()))
        mean = sum(v[:, :-1].sum(axis=0, dtype=np.float64) for v in x.values()) / n
        std = np.sqrt(sum(((v[:, :-1] - mean) ** 2).sum(axis=0) for v in x.values()) / n) + 1e-3
        mean, std = mean.astype(np.float32), std.astype(np.float32)
        p, u = (standard(x[k], mean, std) for k in (1, 0))
        prior = estimated_prior(p, u)
        yield pd.DataFrame([{"w": non_negative_pu(p, u, prior).tobytes(), "mean": mean.tobytes(), "std": std.tobytes(), "prior": prior}])

    got = rows.repartition(1).mapInPandas(learn, "w binary, mean binary, std binary, prior double").collect()
    if not got:
        return None
    r = got[0]
    return {"w": np.frombuffer(r["w"]), "mean": np.frombuffer(r["mean"], np.float32), "std": np.frombuffer(r["std"], np.float32), "prior": r["prior"]}


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), reading only labels and texts where ``trusted`` holds.

    The samples are the rows of least md5(doc_id): the same in each run, and bounded by the two parameters. Rows with a
    null doc_id or quality teach nothing. Without positives the model scores every text with one half.
    """
    h = F.md5(F.concat(F.lit("pu:"), F.col("doc_id").cast("string")))
    good = labels.where(trusted).where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()
    pos = good.withColumn("h", h).orderBy("h").limit(max_positives).select("doc_id", "h", F.lit(1).alias("kind"))
    unl = docs.select("doc_id").where(trusted).where("doc_id IS NOT NULL").distinct().withColumn("h", h).orderBy("h").limit(max_unlabelled).select("doc_id", "h", F.lit(0).alias("kind"))
    picked = written(pos.unionByName(unl), "sample")  # at most max_positives + max_unlabelled ids
    rows = _feature_rows(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("kind", "h", "text"))
    return _learnt(rows) or {"w": None, "mean": None, "std": None, "prior": 0.5}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` (text) with a column ``out`` (0 to 1), from the whole text alone; empty and null texts too. The model is about 8 KB."""
    w, mean, std, prior = model["w"], model["mean"], model["std"], model["prior"]

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if w is None:
                yield pd.Series(np.full(len(texts), prior))
                continue
            z = np.empty(len(texts))
            for at in range(0, len(texts), 512):
                x = np.stack([features(t) for t in texts.iloc[at : at + 512]])
                z[at : at + len(x)] = standard(x, mean, std) @ w[:-1] + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, of(F.col("text")))


def held_out() -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= 0.5); columns of these names are replaced, others stay.

    Each repeated row gets the same score; null and empty texts one of their own; an empty table gives an empty result.
    """
    rows = docs.drop("held_out", "score", "predicted")
    scored = score(rows, fit(docs, labels, ~held_out()))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows that the classifier rejects. Repeated rows share their fate."""
    (mine,) = free_names(docs, "_quality_score")
    return score(docs, fit(docs, labels, ~held_out()), mine).where(F.col(mine) >= 0.5).select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
