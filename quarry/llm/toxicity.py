"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling (gru.py) over all overlapping windows.

A text's logit is the largest of its windows' logits; a slope and an offset fitted on labelled texts turn it into a probability.
The network is fitted on SAMPLE labelled rows of either label at most (the smallest hashes of doc_id), the slope and offset on a fifth of them that the network does not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, gru
from quarry.llm.quality import held_out

SAMPLE, FOLDS, FOLD, THRESHOLD = 1200, 4, 2, 0.3
#: The logit of a text without words.
EMPTY = -12.0


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps of a logistic fit with a weak pull to 1 and 0."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + c, -30, 30)))
        e, v = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(e * logit).sum() + (a - 1), e.sum() + 0.1 * c])
        hess = np.array([[(v * logit * logit).sum() + 1, (v * logit).sum()], [(v * logit).sum(), v.sum() + 0.1]])
        d = np.linalg.solve(hess, grad)
        a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -2, 2)
    return max(float(a), 0.05), float(c)


class Model:
    def __init__(self, texts: list[bytes], y: np.ndarray, rates: tuple[float, float]):
        """rates: how many labelled rows of label 0 and 1 a row of either stands for."""
        self.constant = len(y) < 20 or y.min() == y.max()
        total = np.array([(y == 0).sum() * rates[0], (y == 1).sum() * rates[1]]) if len(y) else np.zeros(2)
        self.rate = float((total[1] + 1) / (total.sum() + 2))
        if self.constant:
            return
        cut = np.random.default_rng(4).random(len(y)) < 0.2
        self.net = gru.train([t for t, c in zip(texts, cut, strict=True) if not c], y[~cut])
        some = np.flatnonzero(cut)
        logit = np.maximum(gru.Scorer(self.net).logits([texts[i] for i in some]), EMPTY) if len(some) else np.zeros(0)
        self.slope, self.offset = calibrate(logit, y[some], np.where(y[some] == 1, *rates[::-1]) if len(some) else np.zeros(0))

    def scorer(self):
        if self.constant:
            return lambda texts: np.full(len(texts), self.rate)
        s = gru.Scorer(self.net)
        return lambda texts: 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(s.logits(texts), EMPTY) + self.offset, -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with _held_out, _score (0 to 1) and _predicted (1 where the score reaches the threshold).

    Columns of docs named _held_out, _score or _predicted give way. Null and empty texts and texts without words get the score of the logit EMPTY. Labels that are null, of held-out ids or of ids without a document teach nothing; an id labelled
    twice has the larger label. With fewer than 20 usable labels, or one class only, every score is the (smoothed) rate of label 1. A null id is not held
    out. Repeated rows are scored alike, extra columns of docs are passed on. An empty table gives an empty result.
    """
    spark, docs = docs.sparkSession, docs.drop("_held_out", "_score", "_predicted")
    known = labels.select(F.col("doc_id").cast("long").alias("known"), F.col(label).cast("int").alias("label")).where("known is not null and label in (0, 1)").where(~held_out(F.col("known"), folds, fold))
    known = known.groupBy("known").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    of = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("known"), "known").limit(sample)
    known = of(0).unionByName(of(1))
    taught = docs.select(docs[id_col].cast("long").alias("known"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), "known")
    rows = taught.select("known", "label", "text").toArrow().sort_by([("known", "ascending"), ("text", "ascending")])  # of 2 * sample labels
    y = rows["label"].to_numpy().astype(np.int64)
    rates = tuple(counts.get(k, 0) / max(int((y == k).sum()), 1) for k in (0, 1))
    model = spark.sparkContext.broadcast(Model(_texts(rows["text"]), y, rates))
    at, names = docs.columns.index(text_col), [*docs.columns, "_score"]

    def score(batches):
        scorer = model.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(_texts(batch.column(at))), pa.float64())], names=names)

    out = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))
    return out.withColumns({"_held_out": held_out(F.col(id_col), folds, fold), "_predicted": F.when(F.col("_score") >= threshold, 1).otherwise(0)})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
