"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, pairs of neighbours and pairs with one word between them, hashed to fixed slots
(words have slots of their own). FTRL-proximal keeps a rate for each coordinate and sets a weight only where the
gathered gradient passes the L1 threshold, so few weights are left and the model is small enough to broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, worker_state
from tidemark.llm.language import words_of
from tidemark.session import ship

SLOTS_LOG2 = 24
WORD_SLOTS_LOG2 = 22  # the first slots, for single words
PAIR_VALUE = 0.5
KEEP_WORDS = 500_000


@dataclass(frozen=True)
class Model:
    slots: np.ndarray  # ascending slots with a weight
    weights: np.ndarray
    bias: float


class Hasher(dict):
    """Word to 64-bit hash; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def features(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Slots and the text of each, with repeats."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        h = np.fromiter((self[w] for t in texts for w in t), np.uint64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(texts)), lengths)
        slots, owner = [(h >> np.uint64(64 - WORD_SLOTS_LOG2)).astype(np.int64)], [doc]
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
            pair = (h[: len(same)][same] * np.uint64(salt) ^ h[gap : gap + len(same)][same]) * np.uint64(0xFF51AFD7ED558CCD)
            pair ^= pair >> np.uint64(32)
            room = (1 << SLOTS_LOG2) - (1 << WORD_SLOTS_LOG2)
            slots.append((1 << WORD_SLOTS_LOG2) + (pair % np.uint64(room)).astype(np.int64))
            owner.append(doc[: len(same)][same])
        return np.concatenate(slots), np.concatenate(owner)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 10, seed: int = 7) -> Model:
    """FTRL-proximal over examples given as arrays of distinct slots; the bias has no penalty.

    A pair counts PAIR_VALUE times as much as a word; the model's weights have that in them.
    """
    slots, flat = np.unique(np.concatenate(examples) if examples else np.empty(0, np.int64), return_inverse=True)
    at = np.split(flat, np.cumsum([len(e) for e in examples])[:-1]) if examples else []
    value = np.where(slots < (1 << WORD_SLOTS_LOG2), 1.0, PAIR_VALUE)
    z, n = np.zeros(len(slots)), np.zeros(len(slots))

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    base = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias, bias_n = float(np.log(base / (1 - base))), 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(at)):
            k = at[i]
            x, w = value[k], weights(z[k], n[k])
            error = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35))) - labels[i]
            g = error * x
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w
            n[k] += g * g
            bias_n += error * error
            bias -= alpha * error / (beta + np.sqrt(bias_n))
    w = weights(z, n) * value
    return Model(slots[w != 0], w[w != 0].astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000) -> Model:
    """Learn from at most max_rows labelled documents, those first by a hash of the id.

    Null labels are no labels; several labels of one id count as toxic if half of them do; ids without a document teach
    nothing. Features are made in parallel; one task, whose input max_rows bounds, runs the sequential learner.
    """
    spark = docs.sparkSession
    ship(spark)
    told = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = told.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def features(batches):
        release()
        hasher = Hasher()
        for whole in batches:
            for batch in cut(whole, "text"):
                slots, owner = hasher.features([words_of(t or "") for t in batch.column("text").to_pylist()])
                pairs = np.unique(owner << SLOTS_LOG2 | slots)
                parts = np.split((pairs & ((1 << SLOTS_LOG2) - 1)).astype("<i4"), np.searchsorted(pairs >> SLOTS_LOG2, np.arange(1, batch.num_rows)))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("y"), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "y", "slots"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "slots"])
        model = ftrl([np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["slots"]], pdf["y"].to_numpy(np.float64))
        return pd.DataFrame({"slots": [model.slots.astype("<i8").tobytes()], "weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias]})

    examples = base.join(F.broadcast(chosen), "id").select(F.col("id").cast("long"), "y", "text").mapInArrow(features, "id long, y int, slots binary")
    row = examples.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(learn, "slots binary, weights binary, bias double").first()
    return Model(np.frombuffer(row["slots"], "<i8"), np.frombuffer(row["weights"], "<f4"), row["bias"]) if row else ftrl([], np.empty(0))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.hasher = model, Hasher()
        self.marked = np.zeros(1 << SLOTS_LOG2, bool)
        self.marked[model.slots] = True

    def score(self, texts: list[str]) -> np.ndarray:
        slots, owner = self.hasher.features([words_of(t) for t in texts])
        hit = self.marked[slots]
        pairs = np.unique(owner[hit] << SLOTS_LOG2 | slots[hit])
        weights = self.model.weights[np.searchsorted(self.model.slots, pairs & ((1 << SLOTS_LOG2) - 1))]
        return 1 / (1 + np.exp(-np.clip(self.model.bias + np.bincount(pairs >> SLOTS_LOG2, weights, len(texts)), -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row from its whole text alone; predicted is 1 from a score of 0.5.

    Null, empty and wordless texts get the score of the bias. Repeated rows are each answered; other columns are
    ignored; an empty table gives an empty result. A model learned from nothing scores 0.5.
    """
    spark = docs.sparkSession
    ship(spark)
    key, held = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    def work(batches):
        scorer = worker_state(key, lambda: Scorer(held.value))
        for whole in batches:
            for batch in cut(whole, "text"):
                s = scorer.score([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
