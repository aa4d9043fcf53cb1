"""Quality classifier: a linear support-vector machine on n-gram indicators scaled by naive-Bayes log-count ratios.

Features are hashed indicators of words, word pairs, word shapes and pairs of shapes. A feature's
scale is the log ratio of its smoothed document counts in the two classes; each document's scaled
vector has length one. The hinge loss is minimised by dual coordinate descent on disjoint shards of
the training rows, whose solutions are averaged; the averaged margin is mapped to a probability by
a logistic curve fitted on rows that no shard has seen.

Training reads at most FIT_ROWS labelled rows, those whose hashed ids are smallest: the bound of
the sample. Scores use the text alone. Scoring is one pass over all rows with a model of fixed size.

Defined results: null or empty texts have no features and get the score of the bias alone; without
training rows of both classes every score is the share of label 1 (0.5 without labels); repeated
rows are scored alike; repeated labels of one id count once, the smallest; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, slices, texts
from .staging import staged

#: Labelled rows that training reads at most, shards of them, and one in how many goes to calibration.
FIT_ROWS, SHARDS, CALIBRATE = 20_000, 8, 5
BITS = 18
#: Penalty of the hinge loss, passes of coordinate descent, weight of the learned part against the mean weight.
PENALTY, PASSES, LEARNED = 1.0, 12, 0.75
MASK = np.uint64((1 << BITS) - 1)


class _Words(dict):
    """Hash and shape of each distinct word, computed once; emptied when full."""

    def __missing__(self, word: str) -> tuple[int, int]:
        core = word.strip("!?.,;:*#$%&|\"'()[]{}<>/\\=-_~^`@+")
        tail = word[len(word.rstrip("!?.,;:*#$%&|\"'()[]{}<>/\\=-_~^`@+")) :][:3]
        case = "0" if not core else "d" if core.isdigit() else "x" if core == core.lower() else "X" if core == core.upper() and len(core) > 1 else "Xx" if core[1:] == core[1:].lower() else "xX"
        if len(self) > 200_000:
            self.clear()
        self[word] = out = (zlib.crc32(core.lower().encode()), zlib.crc32(f"{case}{tail}".encode()))
        return out


_WORDS = _Words()


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text, below 2 ** BITS."""
    found = text.split()
    if not found:
        return np.zeros(0, np.int64)
    both = np.array([_WORDS[w] for w in found], np.uint64)
    word, shape = both[:, 0], both[:, 1]
    with np.errstate(over="ignore"):
        mix = lambda v, salt: ((v + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        same = (word[1:] == word[:-1]).astype(np.uint64)
        parts = [mix(word, 1), mix(shape, 2), mix(word[:-1] * np.uint64(31) + word[1:] * np.uint64(1_000_003), 3), mix(shape[:-1] * np.uint64(31) + shape[1:] * np.uint64(1_000_003) + same, 4)]
    present = np.zeros(1 << BITS, bool) if len(found) > 20_000 else None
    every = np.concatenate(parts).astype(np.int64)
    if present is not None:
        present[every] = True
        return np.flatnonzero(present)
    return np.unique(every)


@dataclass
class Model:
    weights: np.ndarray  # of each feature, already scaled by its ratio
    scale: np.ndarray  # squared ratio of each feature, for the length of a vector
    bias: float
    slope: float
    offset: float

    def margin(self, of: np.ndarray) -> float:
        length = math.sqrt(float(self.scale[of].sum())) if len(of) else 0.0
        return self.bias + (float(self.weights[of].sum()) / length if length > 0 else 0.0)

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(features(text)) + self.offset))))


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, seed: int) -> np.ndarray:
    """Weights, the bias last, that minimise half their squared length plus the penalised hinge losses: dual coordinate descent."""
    y = np.where(labels == 1, 1.0, -1.0)
    count = np.array([max(1, (labels != 1).sum()), max(1, (labels == 1).sum())])
    cap = PENALTY * np.where(labels == 1, 1.0, np.sqrt(count[1] / count[0]))  # the rarer class weighs more
    vectors = []
    for of in rows:
        v = ratio[of]
        length = np.sqrt(np.square(v).sum())
        vectors.append(v / length if length > 0 else v)
    norms = np.array([np.square(v).sum() + 1.0 for v in vectors])
    w, bias, alpha, random = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(PASSES):
        for n in random.permutation(len(rows)):
            of, v = rows[n], vectors[n]
            gradient = y[n] * (w[of] @ v + bias) - 1
            new = min(max(alpha[n] - gradient / norms[n], 0.0), cap[n])
            step = (new - alpha[n]) * y[n]
            if step:
                w[of] += step * v
                bias += step
                alpha[n] = new
    return np.append(w, bias)


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label, draw): the labelled rows with the smallest hashed ids; draw says which shard a row is in, or that it calibrates.

    At most FIT_ROWS ids are broadcast, so no text is shuffled to find its label.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .withColumn("draw", F.xxhash64(F.lit(5), F.col("__id")))
        .orderBy("draw", "__id")
        .limit(FIT_ROWS)
    )
    rows = documents.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return rows.select("text", "label", "draw")


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of documents joined to labels by id. Only a model's fixed-size arrays and the bounded calibration margins reach the driver."""

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in texts(batch.column(0))]
        lists = pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))
        return record_batch(features=lists, label=batch.column(1), draw=batch.column(2))

    rows = training_rows(documents, labels, id_col, text_col, label_col)
    table = staged(map_batches(rows, present, "features array<int>, label int, draw long"), "nbsvm-rows")
    part = F.pmod(F.shiftright("draw", 8), F.lit(CALIBRATE * SHARDS))
    parted = table.withColumn("calibrates", part < SHARDS).withColumn("shard", F.pmod(part, F.lit(SHARDS)).cast("int"))
    train = parted.where("not calibrates")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 << BITS
    zero, one = counts.get(0, 0), counts.get(1, 0)
    if not zero or not one:
        share = 0.5 if not zero + one else min(max(one / (zero + one), 1e-3), 1 - 1e-3)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, math.log(share / (1 - share)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        for batch in batches:
            owner = np.repeat(batch.column(1).to_numpy(), np.diff(batch.column(0).offsets.to_numpy()))
            flat = batch.column(0).flatten().to_numpy()
            for label in (0, 1):
                seen[label] += np.bincount(flat[owner == label], minlength=size)
        at = np.flatnonzero(seen.any(0))
        yield record_batch(feature=pa.array(at, pa.int32()), n0=pa.array(seen[0, at]), n1=pa.array(seen[1, at]))

    found = train.select("features", "label").mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = found.toArrow()  # at most 2 ** BITS rows, as Arrow: rows of Python objects would take the driver hundreds of MB
    seen = np.zeros((2, size))
    for label in (0, 1):
        seen[label, counted["feature"].to_numpy()] = counted[f"n{label}"].to_numpy()
    ratio = np.log((seen[1] + 1) / (one + 2)) - np.log((seen[0] + 1) / (zero + 2))

    def solve(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("draw", kind="stable")
        rows = [np.asarray(f, np.int64) for f in shard.features]
        w = descend(rows, shard.label.to_numpy(), ratio, int(key[0]))
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at], "rows": len(rows)})

    solved = train.groupBy("shard").applyInPandas(solve, "feature int, weight double, rows int")
    total = F.sum(F.col("weight") * F.col("rows")).alias("weight")
    learned = np.zeros(size + 1)
    summed = solved.groupBy("feature").agg(total).toArrow()
    learned[summed["feature"].to_numpy()] = summed["weight"].to_numpy() / (zero + one)
    w, bias = learned[:size], learned[size]
    mean = np.abs(w).mean()
    model = Model(((1 - LEARNED) * mean + LEARNED * w) * ratio, ratio * ratio, float(bias), 1.0, 0.0)

    def margins(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(margin=pa.array([model.margin(np.asarray(f, np.int64)) for f in batch.column(0).to_pylist()], pa.float64()), label=batch.column(1))

    held = map_batches(parted.where("calibrates").select("features", "label"), margins, "margin double, label int").orderBy("margin", "label").toArrow()
    model.slope, model.offset = calibrate(held["margin"].to_numpy(), held["label"].to_numpy(), one / (zero + one))
    return model


def calibrate(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on smoothed targets."""
    if len(set(labels.tolist())) < 2:
        return 4.0, math.log(share / (1 - share)) * 0
    pos, neg = (labels == 1).sum(), (labels != 1).sum()
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack([margins, np.ones_like(margins)], 1), np.array([4.0, 0.0])
    loss = lambda b: float(np.logaddexp(0, x @ b).sum() - t @ (x @ b))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        length = 1.0
        while length > 1e-6 and loss(beta - length * step) > loss(beta):
            length /= 2
        beta = beta - length * step
        if np.abs(length * step).max() < 1e-8:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (4.0, 0.0)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row. The model has 2 ** BITS weights, whatever the corpus."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record_batch(id=batch.column(0), score=pa.array([shared.value.score(t) for t in texts(batch.column(1))], pa.float64()))

    return map_batches(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, score double").withColumnRenamed("id", id_col)


def keep(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, whose score is at least one half."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([shared.value.score(t) >= 0.5 for t in texts(part.column(at))], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: CRC-32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 3 != 1)
