"""Document quality by ordinal cumulative-link regression on hashed text.

Ratings are grades 0 < 1 < ... < top. One weight per hashed feature is shared by all grades, and ordered
thresholds cut the score: ``P(grade <= k) = 1 / (1 + exp(score - threshold_k))``. A document gets its expected grade
and its tail probability, that of reaching the grade asked for; selection keeps it if that is one half at least.

Features are the presence of hashed words, of hashed word starts, and of steps of shape measures (shares of capitals, digits, marks
and repeated words, word length). The model is fitted on the driver to at most ``SAMPLE`` rated documents, the first
by a hash of their ids, so that it doesn't grow with the input; this is the only bounded sample. All documents are scored,
each over its whole text, with a broadcast of fixed size (``BUCKETS`` weights).

Defined results: null and empty texts have shape features only; documents with several different ratings count once
for each in the sample, rows that repeat an id count as the one whose features come first; null ratings and ratings without a document are ignored; with fewer than two different grades in the sample
each document gets the single grade (the top one without ratings) and is kept; rows that repeat are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh
from ledgerloom.llm.minhash import hashed_words

#: Rated documents that the fit takes at most.
SAMPLE = 10_000
#: Hashed words, and steps of each shape measure behind them.
WORDS = 1 << 18
STEPS = 12
MEASURES = 8
BUCKETS = WORDS + STEPS * MEASURES
#: Lengths (bytes) of the word starts that are features too, so that inflected words share weights.
PREFIXES = (4, 5, 6)
#: Words and word starts whose likelihood ratio against the sample's grades is smaller keep the weight 0.
LEAST_RATIO = 40.0


def _kinds() -> np.ndarray:
    out = np.zeros(256, dtype="i8")
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[65:91] = 2
    out[97:123] = 3
    out[48:58] = 4
    out[[ord(c) for c in ".,;:'-"]] = 5
    for c in range(33, 128):
        if out[c] == 0:
            out[c] = 6
    return out


KIND = _kinds()


def features(texts: list[str]) -> list[np.ndarray]:
    """The sorted feature numbers of each text."""
    raw = [t.encode() for t in texts]
    out = []
    for data, words, *heads in zip(raw, *hashed_words(raw, (0, *PREFIXES)), strict=True):
        counts = np.bincount(KIND[np.frombuffer(data, "u1")], minlength=7).astype("f8")
        solid = max(1.0, counts.sum() - counts[1])
        distinct = np.unique(words)
        n = max(1, len(words))
        shares = np.array([counts[2] / solid, counts[4] / solid, counts[5] / solid, counts[6] / solid, 1 - len(distinct) / n, counts[0] / solid])
        steps = np.clip(np.ceil(np.log2(np.maximum(shares, 1e-4) * 1024)), 0, STEPS - 1)
        steps = np.append(steps, [min(STEPS - 1, int(solid / n)), min(STEPS - 1, n.bit_length())])
        shape = WORDS + np.arange(MEASURES) * STEPS + steps.astype("i8")
        out.append(np.concatenate([np.unique((np.concatenate([distinct, *heads]) >> np.uint64(46)).astype("i8")), shape]))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """``rows x grades`` probabilities."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def _telling(rows: list[np.ndarray], grade: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which features' documents have other grades than the sample (by the likelihood ratio)."""
    sizes = np.array([len(r) for r in rows])
    seen = np.bincount(np.concatenate(rows) * len(share) + np.repeat(grade, sizes), minlength=BUCKETS * len(share)).reshape(BUCKETS, -1).astype("f8")
    total = seen.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen > 0, 2 * seen * np.log(seen / (total * (share / share.sum())[None, :])), 0.0).sum(axis=1)
    return ratio >= LEAST_RATIO


def fit(rows: list[np.ndarray], grade: np.ndarray, top: int, epochs: int = 12, rate: float = 0.08, shrink: float = 2e-5) -> Model:
    """Maximum likelihood by adaptive gradient steps over small batches; rare grades weigh a little more."""
    weights = np.zeros(BUCKETS)
    if len(set(grade.tolist())) < 2:
        level = int(grade[0]) if len(grade) else top
        return Model(weights, np.where(np.arange(top) < level, -30.0, 30.0))
    share = np.bincount(grade, minlength=top + 1)
    usable = _telling(rows, grade, share)
    usable[WORDS:] = True
    rows = [r[usable[r]] for r in rows]
    weight = (len(grade) / np.maximum(share, 1) / (share > 0).sum()) ** 0.3
    thresholds = np.linspace(-1.0, 1.0, top) if top > 1 else np.zeros(1)
    squares, t_squares = np.full(BUCKETS, 1e-3), np.full(top, 1e-3)
    rng = np.random.default_rng(3)
    epochs = max(epochs, -(-1500 * 64 // len(rows)))  # enough steps for a small sample too
    for epoch in range(epochs):
        step = rate / (1 + 3.6 * epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            sizes = np.array([len(rows[i]) for i in batch])
            flat, who = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
            score = np.bincount(who, weights=weights[flat], minlength=len(batch))
            y, w = grade[batch], weight[grade[batch]]
            cut = np.concatenate([[-1e9], thresholds, [1e9]])
            up = 1 / (1 + np.exp(np.clip(score - cut[y + 1], -60, 60)))
            low = 1 / (1 + np.exp(np.clip(score - cut[y], -60, 60)))
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up), low * (1 - low)
            d_score = w * (d_up - d_low) / p / len(batch)  # of the loss
            gradient = np.bincount(flat, weights=d_score[who], minlength=BUCKETS)
            hit = np.nonzero(gradient)[0]
            squares[hit] += gradient[hit] ** 2
            weights[hit] -= step * gradient[hit] / np.sqrt(squares[hit]) + step * shrink * weights[hit]
            d_cut = np.zeros(top)
            np.add.at(d_cut, y[y < top], -(w * d_up / p / len(batch))[y < top])
            np.add.at(d_cut, y[y > 0] - 1, (w * d_low / p / len(batch))[y > 0])
            t_squares += d_cut**2
            thresholds = np.sort(thresholds - step * d_cut / np.sqrt(t_squares))
            thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(top)) - 1e-3 * np.arange(top)
            if top > 1:
                gap = np.maximum(np.diff(thresholds), 1e-2)
                thresholds = np.concatenate([thresholds[:1], thresholds[0] + np.cumsum(gap)])
    return Model(weights.astype("f4").astype("f8"), thresholds)


def train(docs: DataFrame, ratings: DataFrame, grade: Column, top: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` rated documents; ``grade`` is computed over ``ratings``."""
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, top))
    chosen = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)  # bounded, so it may be broadcast
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "grade": part["grade"].to_numpy(), "f": [x.astype("i4").tobytes() for x in features(part["text"].tolist())]})

    kind = ratings.schema[id_col].dataType.simpleString()
    rows = own.join(F.broadcast(chosen), "id").mapInPandas(run, f"id {kind}, grade int, f binary")
    # rows that repeat an id give one row a rating, so what is collected is bounded by the sample
    got = rows.groupBy("id", "grade").agg(F.min("f").alias("f")).toPandas()
    got = got.assign(f=got["f"].map(bytes)).sort_values(["id", "grade", "f"])
    return fit([np.frombuffer(x, "i4").astype("i8") for x in got["f"]], got["grade"].to_numpy(dtype="i8"), top)


def scored(docs: DataFrame, model: Model, at_least: int, text_col: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a column ``name``: the struct (expected_grade, tail_probability)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype("f4"), model.thresholds))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts: pd.Series) -> pd.DataFrame:
        weights, thresholds = sent.value
        own = Model(weights, thresholds)
        total = []
        for at in range(0, len(texts), 256):
            total.extend(float(weights[f].sum(dtype="f8")) for f in features([t or "" for t in texts.iloc[at : at + 256]]))
        p = own.grades(np.array(total, dtype="f8"))
        return pd.DataFrame({"expected_grade": p @ np.arange(p.shape[1]), "tail_probability": p[:, at_least:].sum(axis=1)})

    return docs.withColumn(name, score(F.col(text_col).cast("string")))


def label_grade() -> Column:
    """Grades of the labels table: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def select_documents(docs: DataFrame, labels: DataFrame, at_least: int = 2, level: float = 0.5) -> DataFrame:
    """The documents whose probability of the grade ``at_least`` reaches ``level``, with their own columns."""
    model = train(docs, labels, label_grade(), top=2)
    (name,) = fresh(docs, "quality")
    return scored(docs, model, at_least, name=name).where(F.col(f"{name}.tail_probability") >= level).drop(name)


def grade_documents(docs: DataFrame, labels: DataFrame, at_least: int = 2, level: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for each row."""
    model = train(docs, labels, label_grade(), top=2)
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, at_least)
    return out.select("doc_id", "quality.expected_grade", "quality.tail_probability", (F.col("quality.tail_probability") >= level).alias("kept"))
