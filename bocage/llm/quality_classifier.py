"""Quality classifier by co-training of a text view and a metadata view.

Method.  Two logistic models see different views of a document: one its text (shares of
symbols, capitals, digits, repeated words and lines, lengths), one its metadata (source, language,
stated length).  Both are fitted to a bounded sample of labelled documents.  Over ``ROUNDS``
rounds each gives its confident pseudo-labels on all unlabelled documents to the other, and
both are fitted again.  A quarter of each class of the labelled sample is held out all the
time; on it each view is calibrated (a slope and an offset) and the calibrated views are
combined, weighted by a last logistic fit.  Every document is then scored.

Scale.  Only the labelled sample (``LABELLED`` documents, a documented bound) reaches the
driver, as rows of a few dozen numbers; it is chosen by the order of a hash of the doc_id.
The views of all documents are written once, 16 numbers each.  A step of a fit is a scan of
them: tasks send sums of gradients and Hessians, of one size whatever the input, added up by
Spark.  What a document has been given is found again from the models of the rounds before, so
no state is kept per document.  Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LABELLED = 8_000  # labelled documents the fit may use
ROUNDS = 5
STEPS = 25  # of one fit over all documents, at most
SURE = 0.97
THRESHOLD = 0.5
SOURCES, LANGS = 64, 16
TEXT_FEATURES = 12


def text_features(text: str | None) -> list[float]:
    """Text view of a document; an empty one gives zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * TEXT_FEATURES
    n, size = len(words), len(raw)
    bare = raw.translate(None, b"#*$%&|<>!@^~_=+{}[]\\/")
    letters = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    digits = raw.translate(None, b"0123456789")
    commas = raw.translate(None, b".,;:?'\"()-")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    follow = sum(a == b for a, b in zip(words, words[1:]))
    kinds = len(set(words))
    longest = max(map(len, words))
    mean = sum(map(len, words)) / n
    return [
        (size - len(bare)) / n,
        (size - len(letters)) / n,
        (size - len(digits)) / n,
        (size - len(commas)) / n,
        follow / n,
        np.log1p(n) - np.log1p(kinds),
        1 - len(set(lines)) / len(lines),
        np.log1p(n) / 10,
        mean / 10,
        min(longest, 100) / 100,
        float((size - len(letters)) > 0.3 * size),
        float(4 * kinds < n),
    ]


def meta_features(source, lang, n_chars) -> list[tuple[int, float]]:
    """Metadata view as (column, value): hashed source and language, stated length."""
    at = lambda x, n: xxhash.xxh64_intdigest(str(x).encode()) % n
    known = n_chars is not None and n_chars == n_chars
    return [
        (at(source, SOURCES), 1.0),
        (SOURCES + at(lang, LANGS), 1.0),
        (SOURCES + LANGS, np.log1p(max(float(n_chars), 0.0)) / 10 if known else 0.0),
        (SOURCES + LANGS + 1, 0.0 if known else 1.0),
    ]


META_FEATURES = SOURCES + LANGS + 2


def views(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t) for t in frame["text"]], dtype=np.float64).reshape(len(frame), TEXT_FEATURES)
    meta = np.zeros((len(frame), META_FEATURES))
    for i, row in enumerate(zip(frame["source"], frame["lang"], frame["n_chars"])):
        for c, v in meta_features(*row):
            meta[i, c] = v
    return text, meta


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, offset last (not shrunk)."""
    x = np.c_[x, np.ones(len(x))]
    shrink = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(shrink), x.T @ (y - p) - shrink * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def taught(views: list[np.ndarray], rounds: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per view the rows that the other one was sure of, and their labels.  A row counts in the
    first of the rounds in which a view is sure of it."""
    open_ = np.ones(len(views[0]), dtype=bool)
    rows, labels = [[], []], [[], []]
    edge = np.log(SURE / (1 - SURE))
    for weights in rounds:
        z = [logit(v, w) for v, w in zip(views, weights)]
        sure = [open_ & (np.abs(v) >= edge) for v in z]
        for i in (0, 1):  # what view i is sure of teaches the other
            rows[1 - i].append(np.flatnonzero(sure[i]))
            labels[1 - i].append(z[i][sure[i]] > 0)
        open_ &= ~(sure[0] | sure[1])
    return [(np.concatenate(r), np.concatenate(y).astype(float)) for r, y in zip(rows, labels)]


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Count, gradient and Hessian of the logistic likelihood, in one row."""
    p = 1 / (1 + np.exp(-logit(x, w)))
    x = np.c_[x, np.ones(len(x))]
    return np.r_[len(x), x.T @ (y - p), ((x.T * np.maximum(p * (1 - p), 1e-6)) @ x).ravel()]


def stepped(total: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The Newton step of ``fit`` from sums over all rows."""
    n = len(w)
    shrink = np.r_[np.full(n - 1, ridge), 1e-6]
    return np.linalg.solve(total[1 + n :].reshape(n, n) + np.diag(shrink), total[1 : 1 + n] - shrink * w)


def co_train(
    labelled: list[np.ndarray], y: np.ndarray, train: np.ndarray, held: np.ndarray, free: Callable
) -> dict:
    """Model from both views of the labelled sample; ``train``, ``held``: its rows to fit and to
    calibrate.  ``free(scale, rounds, weights)``: ``sums`` of each view over all unlabelled
    documents.  Text features are standardised by the labelled sample."""
    centre, spread = labelled[0].mean(axis=0), labelled[0].std(axis=0) + 1e-3
    own = [(labelled[0] - centre) / spread, labelled[1]]
    weights = [fit(v[train], y[train]) for v in own]
    rounds, given = [], [0, 0]
    for _ in range(ROUNDS):
        rounds.append(weights)
        for step in range(STEPS):
            parts = free((centre, spread), rounds, weights)
            if not step:
                now = [part[0] for part in parts]
            if now == given:
                break
            steps = [
                stepped(part + sums(v[train], y[train], w), w) for part, v, w in zip(parts, own, weights)
            ]
            weights = [w + move for w, move in zip(weights, steps)]
            if max(np.abs(move).max() for move in steps) < 1e-6:
                break
        if now == given:  # no document that had no pseudo-label
            break
        given = now
    z = [logit(v[held], w) for v, w in zip(own, weights)]
    calibration = [fit(v[:, None], y[held], 1e-3) for v in z]
    z = np.c_[tuple(logit(v[:, None], c) for v, c in zip(z, calibration))]
    return {"centre": centre, "spread": spread, "weights": weights, "calibration": calibration, "last": fit(z, y[held], 1e-3)}


def probabilities(model: dict, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probability of good quality: by text, by metadata, combined."""
    x = ((text - model["centre"]) / model["spread"], meta)
    z = [
        logit(logit(v, w)[:, None], c) for v, w, c in zip(x, model["weights"], model["calibration"])
    ]
    both = logit(np.c_[z[0], z[1]], model["last"])
    return tuple(1 / (1 + np.exp(-v)) for v in (*z, both))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("double").alias("n_chars"),
    )


def _dense(x: np.ndarray) -> list[np.ndarray]:
    """Both views from the stored numbers: text features, column of source and of language, length, none stated."""
    meta = np.zeros((len(x), META_FEATURES))
    at = np.arange(len(x))
    for c in (TEXT_FEATURES, TEXT_FEATURES + 1):
        meta[at, x[:, c].astype(int)] = 1.0
    meta[:, SOURCES + LANGS :] = x[:, TEXT_FEATURES + 2 :]
    return [x[:, :TEXT_FEATURES], meta]


def parted(y: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit and rows to calibrate: of each class every fourth by hash is held out.  The
    only row of a class is both."""
    held, train = np.zeros(len(y), dtype=bool), np.zeros(len(y), dtype=bool)
    hashes = np.array([xxhash.xxh64_intdigest(str(i)) for i in ids], dtype=np.uint64)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        rows = rows[np.argsort(hashes[rows], kind="stable")]
        held[rows[::4]] = True
        train[rows] = ~held[rows] | (len(rows) == 1)
    return train, held


def trained(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model; None without labelled documents of both classes."""
    order = F.xxhash64("doc_id")
    classes = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    chosen = saved(classes.orderBy(order, "doc_id").limit(LABELLED), "sample")  # a bound that allows the broadcast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, *meta in zip(frame["text"], frame["source"], frame["lang"], frame["n_chars"]):
                (source, _), (lang, _), (_, size), (_, none) = meta_features(*meta)
                rows.append([*text_features(text), float(source), float(lang), float(size), none])
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"].astype("Int64"), "quality": frame["quality"].astype("Int64"), "x": rows}
            )

    found = _columns(docs).join(F.broadcast(chosen), "doc_id", "left").mapInPandas(
        run, "doc_id long, quality int, x array<double>"
    )
    found = saved(found, "views")
    own = found.where("quality IS NOT NULL").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    own = own.sort_values("doc_id")
    y = own["quality"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None
    others = found.where("quality IS NULL").select("x")
    sizes = [TEXT_FEATURES + 1, META_FEATURES + 1]
    sizes = [1 + n + n * n for n in sizes]

    def free(scale: tuple, rounds: list, weights: list) -> list[np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(sum(sizes))
            for frame in frames:
                if len(frame):
                    text, meta = _dense(np.stack(frame["x"].to_numpy()))
                    views = [(text - scale[0]) / scale[1], meta]
                    total += np.concatenate(
                        [sums(v[rows], y, w) for v, (rows, y), w in zip(views, taught(views, rounds), weights)]
                    )
            some = np.flatnonzero(total)
            yield pd.DataFrame({"k": some.astype(np.int32), "v": total[some]})

        # as decimals: their sum is the same in any order
        added = others.mapInPandas(run, "k int, v double").groupBy("k").agg(
            F.sum(F.col("v").cast("decimal(28,9)")).cast("double").alias("v")
        )
        total = np.zeros(sum(sizes))
        for k, v in added.collect():
            total[k] = v
        return [total[: sizes[0]], total[sizes[0] :]]

    train, held = parted(y, own["doc_id"].to_numpy())
    return co_train(_dense(np.stack(own["x"].to_numpy())), y, train, held, free)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, p_text, p_meta, score, kept`` per row.

    Null or empty text, null metadata: features 0.  Labels: null ones are no labels, of
    several for a document the lowest counts.  Without labelled documents of both classes
    all scores are 1 and every document is kept.  Repeated rows get the same score.  Empty
    table: no rows.  Other columns are not read.
    """
    score = scorer(docs, labels)
    return _columns(docs).withColumn("p", score).select(
        "doc_id", "p.*", (F.col("p.score") >= threshold).alias("kept")
    )


def scorer(docs: DataFrame, labels: DataFrame):
    """Column ``struct<p_text, p_meta, score>`` over text, source, lang and n_chars."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    @F.pandas_udf("p_text double, p_meta double, score double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        if model.value is None:
            p = (np.ones(len(text)),) * 3
        else:
            frame = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars})
            p = probabilities(model.value, *views(frame))
        return pd.DataFrame({"p_text": p[0], "p_meta": p[1], "score": p[2]})

    return score(
        F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.col("n_chars").cast("double"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``; columns as they came."""
    return docs.where(scorer(docs, labels)["score"] >= threshold)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
