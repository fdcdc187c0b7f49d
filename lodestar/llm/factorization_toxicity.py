"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words (lower case) and their beginnings of several
lengths, which stand for families of inflected words; a term that two or four
different tokens share counts as a further term each. Each is hashed to one of 2^20
places. The score of a text with the terms x is::

    sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)

The factors v let a pair of terms weigh more (an insult with a mention of a group)
or less (a quotation) than the two do alone. Training is bounded: TRAIN_ROWS
labelled rows of TRAIN_BYTES at most (chosen by a hash of the id if there are more)
give their terms to the driver, which keeps the terms that tell the labels apart (their
shares among both labels differ by Z standard errors, over all rows or over those that
hold one of the clearest terms) and fits by Adagrad on logistic loss. Terms that say nothing would otherwise add up in long texts. Scoring is a
column function on each text where it lies: no shuffle.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import fold_of, table, text_of, written
from lodestar.llm.labelled import bounded_labels, labelled_texts
from lodestar.llm.shingles import words

PLACES = 1 << 20
TRAIN_ROWS = 24_000
FOLDS, HELD_OUT = 5, 0
FACTORS = 8
Z = 3.0
MIN_ROWS = 3
#: Partners are looked for among the rows of so many of the clearest terms, with this distance.
STRONG, PAIR_Z = 16, 5.0
#: Bytes of terms that go to the driver at most; beyond, a hash of the id chooses fewer rows.
TRAIN_BYTES = 128 << 20
BEGINNINGS = (4, 5, 6, 8)
CACHE_WORDS = 120_000
#: The score of every text if no label is known.
PRIOR = 0.0

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Machine:
    """places (sorted), their weights and factors, and the constant."""

    places: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    constant: float

    def score(self, terms: np.ndarray) -> float:
        """The probability of the label for a text's distinct terms."""
        at = np.searchsorted(self.places, terms)
        at = at[at < len(self.places)] if len(at) and at[-1] >= len(self.places) else at
        known = at[self.places[at] == terms[: len(at)]] if len(at) else at
        value = self.constant
        if len(known):
            own = self.factors[known]
            total = own.sum(axis=0)
            value += float(self.weights[known].sum()) + 0.5 * float(total @ total - (own * own).sum())
        return float(1 / (1 + np.exp(-np.clip(value, -40, 40))))


class Terms(dict):
    """Token -> places of its words and their beginnings; emptied when large."""

    def __missing__(self, token: str) -> np.ndarray:
        names = []
        for word in _WORD.findall(token.lower()):
            names += [word, *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n)]
        value = np.array([xxhash.xxh3_64_intdigest(x) % PLACES for x in names], dtype=np.int32)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = value
        return value


_TERMS = Terms()


def terms(text: str) -> np.ndarray:
    """The distinct places of a text's terms, ascending."""
    found = list(map(_TERMS.__getitem__, set(words(text))))
    if not found:
        return np.zeros(0, dtype=np.int32)
    places, tokens = np.unique(np.concatenate(found), return_counts=True)
    more = [((places[tokens >= n].astype(np.int64) * 2654435761 + n) % PLACES).astype(np.int32) for n in (2, 4)]
    return np.unique(np.concatenate([places, *more]))


def distances(rows: list[np.ndarray], labels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in so many rows, and by how many standard errors their shares of the
    rows with and without the label differ."""
    positive = int((labels == 1).sum())
    negative = len(labels) - positive
    if not positive or not negative:
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    # Counted row by row in two small arrays: the rows of all terms at once would be copied.
    both, hits = np.zeros(PLACES, dtype=np.int32), np.zeros(PLACES, dtype=np.int32)
    for row, label in zip(rows, labels, strict=True):
        both[row] += 1  # a row's places are distinct
        if label == 1:
            hits[row] += 1
    places = np.flatnonzero(both >= least)
    n, own = both[places].astype(float), hits[places].astype(float)
    share = n / len(labels)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))
    return places.astype(np.int32), np.abs(own / positive - (n - own) / negative) / error


def informative(rows: list[np.ndarray], labels: np.ndarray, z: float = Z, least: int = MIN_ROWS, strong: int = STRONG, pair_z: float = PAIR_Z) -> np.ndarray:
    """The places whose shares of the rows with and without the label differ clearly.

    Also those that do so only among the rows that hold one of the ``strong`` clearest
    places: a partner that is as frequent in both kinds of rows says nothing alone, but
    its pair with an insult does.
    """
    places, apart = distances(rows, labels, least)
    chosen = [places[apart >= z]]
    clearest = places[np.argsort(-apart, kind="stable")[:strong]]
    number = np.zeros(PLACES, dtype=np.int16)
    number[clearest] = np.arange(1, len(clearest) + 1)
    holders: list[list[int]] = [[] for _ in clearest]
    for i, row in enumerate(rows):
        for k in (found := number[row])[found > 0].tolist():
            holders[k - 1].append(i)
    for held in holders:
        own, far = distances([rows[i] for i in held], labels[held], least)
        chosen.append(own[far >= pair_z])
    return np.unique(np.concatenate(chosen)).astype(np.int32)


def gradient(rows: list[np.ndarray], labels: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean logistic loss, by weights and by factors; rows are distinct places, not empty."""
    sizes = np.array([len(x) for x in rows])
    ids = np.concatenate(rows)
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), sizes)
    f = v[ids]
    total = np.add.reduceat(f, begins, axis=0)
    value = np.add.reduceat(w[ids], begins) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((f * f).sum(axis=1), begins))
    gap = (1 / (1 + np.exp(-np.clip(value, -40, 40))) - labels) / len(rows)
    slope = gap[row][:, None] * (total[row] - f)
    gv = np.stack([np.bincount(ids, weights=slope[:, j], minlength=len(w)) for j in range(v.shape[1])], axis=1)
    return np.bincount(ids, weights=gap[row], minlength=len(w)), gv


def fit(rows: list[np.ndarray], labels: np.ndarray, k: int = FACTORS, steps: int = 3000, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit on rows of distinct places and 0/1 labels, the order given."""
    places = informative(rows, labels)
    m = len(places)
    random = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4))
    w, v = np.zeros(m + 1), random.normal(0, 0.02, (m + 1, k))
    w[m], v[m] = np.log(share / (1 - share)), 0.0
    if m == 0:
        return Machine(places, w[:0], v[:0], float(w[m]))
    index = np.full(PLACES, -1, dtype=np.int32)
    index[places] = np.arange(m)
    own = [np.append((x := index[row])[x >= 0], m) for row in rows]  # the last place is the constant
    sum_w, sum_v = np.full(m + 1, 1e-2), np.full((m + 1, k), 1e-2)
    for _ in range(max(4, -(-steps * batch // len(own)))):
        order = random.permutation(len(own))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            gw, gv = gradient([own[i] for i in part], labels[part], w, v)
            gw, gv = gw + decay * w, gv + decay * v
            gw[m] -= decay * w[m]
            gv[m] = 0.0
            sum_w += gw**2
            sum_v += gv**2
            w -= rate * gw / np.sqrt(sum_w)
            v -= 0.5 * rate * gv / np.sqrt(sum_v)
    return Machine(places, w[:m], v[:m], float(w[m]))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = TRAIN_ROWS) -> Machine | None:
    """The machine fitted outside the held-out fold; None without labelled documents."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "terms": [terms(x).tobytes() for x in frame["text"]]})

    chosen = labelled_texts(docs, bounded_labels(labels, column, folds, held_out, bound))
    found = written(chosen.mapInPandas(run, "doc_id long, label int, terms binary"), "terms")
    size = found.agg(F.coalesce(F.sum(F.octet_length("terms") + 24), F.lit(0)).alias("n")).first()["n"]
    if size > TRAIN_BYTES:
        found = found.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < int((1 << 30) * TRAIN_BYTES / size))
    rows = sorted((r["doc_id"], r["label"], bytes(r["terms"])) for r in found.toLocalIterator())
    if not rows:
        return None
    return fit([np.frombuffer(body, np.int32) for _, _, body in rows], np.array([label == 1 for _, label, _ in rows], dtype=float))


def score(machine: Machine | None, text: Column) -> Column:
    """The score of a text that isn't null."""
    if machine is None:
        return F.lit(PRIOR)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([machine.score(terms(x)) for x in texts], dtype=float)

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A null text counts as empty and gets the constant's score. A null id is never
    held out nor learnt from. Rows with one id share its label; repeated rows get
    equal scores. Without labelled rows every score is PRIOR; an empty table stays
    empty. Other columns are not read.
    """
    machine = train(docs, labels)
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score(machine, text_of(docs)).alias("score"))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text of ``documents``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_factorization_toxicity": op1_factorization_toxicity}
ORACLES: dict[str, str] = {}
