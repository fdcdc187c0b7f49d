"""Quality classifier: random Fourier features of document statistics, ridge, isotonic.

Statistics of a text (lengths, shares of classes of characters, repeats, shapes of
words and lines) are standardised; the cosines of FEATURES random projections
approximate a Gaussian kernel on them, and only they carry the score. Ridge scores solve normal equations that
each partition sums over its rows and the driver adds up: their size is fixed by
FEATURES and the number of parts, whatever the number of rows. Scores of labelled
rows that the equations didn't see are then mapped to probabilities by isotonic
regression (pooled adjacent violators, linear between the pools).

Training uses TRAIN_ROWS labelled rows at most, chosen by a hash of the id if there
are more. Scoring is a column function on each text where it lies: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import fold_of, internal, table, text_of, written
from lodestar.llm.labelled import bounded_labels, labelled_texts
from lodestar.llm.shingles import shingle_hashes, word_hashes, words

FOLDS, HELD_OUT = 4, 2
TRAIN_ROWS = 100_000
FEATURES = 384
PARTS = 24
RIDGE = 1e-2
#: Of the rows to learn from, every CALIBRATION-th (by a hash of the id) calibrates.
CALIBRATION = 4
THRESHOLD = 0.7
#: The score of every text if no label is known: nothing speaks for a rejection.
PRIOR = 1.0

_LETTER_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)


def _classes() -> np.ndarray:
    """256 x n: the classes of bytes whose shares are statistics."""
    groups = [
        range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1), range(ord("0"), ord("9") + 1), range(0x80, 0x100), b" ", b"\n", b"\t\x0b\x0c\r",
        b".", b",", b"!", b"?", b":;", b"\"'`", b"-_", b"()[]{}", b"/\\", b"@", b"#*$%&", b"<>", b"|", b"=+~^", [*range(0, 9), *range(14, 32), 127],
    ]
    table_ = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        table_[list(group), k] = 1
    return table_


_CLASS = _classes()
N_STATISTICS = _CLASS.shape[1] + 17


def statistics(text: str) -> np.ndarray:
    """The statistics of one text, finite also for an empty one."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _CLASS / max(1, len(data))
    found = words(text)
    n = len(found)
    hashes = word_hashes(found)
    sizes = np.fromiter(map(len, found), dtype=np.float64, count=n)
    _, repeats = np.unique(hashes, return_counts=True)
    grams = np.unique(shingle_hashes(hashes)) if n else hashes
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    p = counts[counts > 0] / max(1, len(data))
    rest = [
        math.log1p(len(text)), math.log1p(n), math.log1p(len(lines)),
        sizes.mean() if n else 0.0, sizes.std() if n else 0.0, math.log1p(sizes.max()) if n else 0.0,
        float((sizes <= 3).mean()) if n else 0.0, float((sizes >= 15).mean()) if n else 0.0,
        len(repeats) / n if n else 1.0, float(repeats.max()) / n if n else 0.0,
        len(grams) / max(1, n - 4), len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)), sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)),
        counts[65:91].sum() / letters, -float((p * np.log(p)).sum()), math.log1p(sum(len(m.group()) for m in _LETTER_RUN.finditer(text))),
    ]
    rest[12] = math.log1p(rest[12])
    return np.concatenate([np.sqrt(shares), rest])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, rows: np.ndarray) -> np.ndarray:
        """The Fourier features and one."""
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.projection + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        found = self.raw(rows)
        return np.clip(found if self.knots is None else np.interp(found, *self.knots), 0.0, 1.0)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function nearest to the labels: pools' mean scores and labels."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of labels, rows
    for s, y in zip(scores[order], labels[order], strict=True):
        pools.append([float(s), float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x, y, n = np.array(pools).T
    return x / n, y / n


def unfitted(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = 1.0, seed: int = 11) -> Model:
    random = np.random.default_rng(seed)
    d = len(mean)
    projection = random.normal(0, 1 / (width * math.sqrt(d)), (d, features))
    return Model(mean, scale, projection, random.uniform(0, 2 * math.pi, features), np.zeros(features + 1))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = TRAIN_ROWS) -> Model | None:
    """The model fitted outside the held-out fold; None without labelled documents."""

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": (frame["label"] == 1).astype(float), "x": [statistics(t) for t in frame["text"]]})

    chosen = labelled_texts(docs, bounded_labels(labels, column, folds, held_out, bound))
    rows = written(chosen.mapInPandas(measured, "doc_id long, label double, x array<double>"), "statistics")

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS)
        for frame in frames:
            x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, N_STATISTICS))
            n, total, square = n + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
        yield pd.DataFrame({"n": [n], "a": [total.tobytes()], "b": [square.tobytes()]})

    # A bounded table in a bounded number of parts: so many sums come to the driver.
    dealt = rows.coalesce(PARTS)
    sums = dealt.mapInPandas(moments, "n long, a binary, b binary").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return None
    mean = np.sum([np.frombuffer(r["a"]) for r in sums], axis=0) / n
    scale = np.sqrt(np.maximum(np.sum([np.frombuffer(r["b"]) for r in sums], axis=0) / n - mean**2, 0))
    model = unfitted(mean, np.where(scale > 1e-9, scale, 1.0))
    size = len(model.weights)
    upper = np.triu_indices(size)  # the matrix is symmetric

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for frame in frames:
            if len(frame):
                z = model.features(np.stack(frame["x"].to_list()))
                a += z.T @ z
                b += z.T @ frame["label"].to_numpy()
        yield pd.DataFrame({"a": [a[upper].tobytes()], "b": [b.tobytes()]})

    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATION)) == 0
    a, b = np.zeros((size, size)), np.zeros(size)
    for r in dealt.where(~calibrates).mapInPandas(equations, "a binary, b binary").collect():
        a[upper] += np.frombuffer(r["a"])
        b += np.frombuffer(r["b"])
    a = np.triu(a) + np.triu(a, 1).T
    weights = np.linalg.solve(a + RIDGE * max(1.0, n / 1000) * np.eye(size), b)
    fitted = Model(model.mean, model.scale, model.projection, model.phase, weights)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = fitted.raw(np.stack(frame["x"].to_list())) if len(frame) else np.zeros(0)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "raw": raw, "label": frame["label"]})

    unseen = sorted(map(tuple, dealt.where(calibrates).mapInPandas(scored, "doc_id long, raw double, label double").collect()))
    if not unseen:
        return fitted
    knots = isotonic(np.array([r[1] for r in unseen]), np.array([r[2] for r in unseen]))
    return Model(model.mean, model.scale, model.projection, model.phase, weights, knots)


def score(model: Model | None, text: Column) -> Column:
    """The score of a text that isn't null."""
    if model is None:
        return F.lit(PRIOR)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(np.concatenate([model.score(np.stack([statistics(t) for t in texts[k : k + 1024]])) for k in range(0, len(texts), 1024)]))

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A null text counts as empty, which has statistics and a score as others. A null id
    is never held out nor learnt from. Rows with one id share its label; repeated
    rows get equal scores. Without labelled rows every score is PRIOR; an empty
    table stays empty. Other columns are not read.
    """
    model = train(docs, labels)
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score(model, text_of(docs)).alias("score"))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    model = train(docs, labels)
    out = internal(docs, "__score")
    rows = docs.withColumn(out, score(model, text_of(docs)))
    return rows.where(F.col(out) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of ``documents``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_fourier_quality": op6_fourier_quality}
ORACLES: dict[str, str] = {}
