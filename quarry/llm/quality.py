"""Quality of documents: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

Words are runs of letters and digits or runs of other characters ("word***" is two). All words of the corpus are counted; the VOCABULARY most frequent
ones get vectors. Every word has a sparse random index vector (two signed places of DIM); a frequent word's vector
is the sum of the index vectors of the words within REACH places of each of its own, over the whole corpus, those to its right turned by one place,
then centred and scaled to length 1. Any other word stands for itself by its index vector. The corpus's sums are one matrix of fixed size; tasks add up their own, and
the sums are added by row blocks.

Documents. The mean and the deviation of their words' vectors, and the root mean square of the step from a word's vector to the next one's; nothing
else: without the vectors every document looks the same.
Two layers turn them into a logit; its temperature is fitted on labelled rows that the weights were not fitted on.

The network is fitted on SAMPLE labelled rows at most (the smallest hashes of doc_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, textkit

U = textkit.U
VOCABULARY, DIM, REACH, BLOCK, POOLS = 1 << 14, 32, 2, 256, 3
SAMPLE, FOLDS, THRESHOLD = 20_000, 5, 0.3
HIDDEN, EPOCHS = 24, 60

#: Of each byte: 0 space, 1 letter or digit (all bytes of 128 and above), 2 other.
_KIND = np.array([0 if textkit.SPACE[c] else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Pieces(textkit.Words):
    """The words of some texts: runs of bytes of one kind, spaces left out."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts) + b"\n" if texts else b""
        data = np.frombuffer(self.buf, np.uint8)
        kind = _KIND[data]
        new = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        word = kind[new] > 0
        self.starts, self.ends = new[word], np.append(new[1:], len(data))[word]
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.counts = np.diff(self.first)
        self._data, self._space = data, kind == 0


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def _pieces(texts: list[bytes]):
    """Groups of about equal bytes: (number of the first text, pieces, hashes)."""
    for a, b in textkit.groups([len(t) for t in texts]):
        w = Pieces(texts[a:b])
        yield a, w, w.hashes()


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two places of each word's index vector, and the sign of the first; the second has the other one."""
    return (h & U(DIM - 1)).astype(np.int64), ((h >> U(8)) & U(DIM - 1)).astype(np.int64), np.where((h >> U(16)) & U(1), 1.0, -1.0)


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> np.ndarray:
    """The sorted hashes of the most frequent words, ties to the smaller hash."""

    def count(batches):
        for batch in batches:
            for _, _, h in _pieces(_texts(batch.column(0))):
                keys, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = docs.select(docs[text_col].cast("string")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    folder = common.scratch(docs.sparkSession)
    top = common.most_frequent(common.table(counts, folder, "words"), size).select("word").toArrow()  # of size rows at most
    common.drop(docs.sparkSession, folder, "words")
    return np.sort(top["word"].to_numpy().astype(np.int64).view(U))


def find(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The row of each hash in the vocabulary, -1 where it has none."""
    if not len(words):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, -1)


def contexts(texts: list[bytes], words: np.ndarray) -> np.ndarray:
    """(words, DIM): the sums of the index vectors around each frequent word."""
    total = np.zeros(len(words) * DIM)
    for _, w, h in _pieces(texts):
        row, (p, q, sign), doc = find(words, h), index_vectors(h), np.repeat(np.arange(len(w.counts)), w.counts)
        for d in range(1, REACH + 1):
            same = doc[d:] == doc[:-d]
            for own, other, turn in ((row[:-d], slice(d, None), 1), (row[d:], slice(None, -d), 0)):
                some = same & (own >= 0)
                base, s = own[some] * DIM, sign[other][some]
                for place, by in ((p, s), (q, -s)):
                    total += np.bincount(base + ((place[other][some] + turn) & (DIM - 1)), by, len(total))
    return total.reshape(-1, DIM)


def scaled(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length 1 from the corpus's sums, centred; zero where there is no context."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seen = np.abs(sums).sum(1) > 0
    out = unit(sums)
    if seen.any():
        out[seen] -= out[seen].mean(0)
    return unit(out).astype(np.float32)


def word_vectors(docs: DataFrame, words: np.ndarray, text_col: str = "text") -> np.ndarray:
    """The vectors of these words, from all texts."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(words)  # VOCABULARY hashes at most

    def gather(batches):
        total = np.zeros((-(-len(known.value) // BLOCK) * BLOCK, DIM))
        for batch in batches:
            total[: len(known.value)] += contexts(_texts(batch.column(0)), known.value)
        rows = total.astype(np.float32).reshape(-1, BLOCK * DIM)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["block", "rows"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(r, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "rows"])

    kind = "block int, rows binary"
    out = np.zeros((-(-len(words) // BLOCK), BLOCK * DIM))
    if len(words):
        blocks = docs.select(docs[text_col].cast("string")).mapInArrow(gather, kind).repartition("block").mapInArrow(add, kind).toArrow()  # VOCABULARY * DIM numbers
        for k, r in zip(blocks["block"].to_pylist(), blocks["rows"].to_pylist(), strict=True):
            out[k] += np.frombuffer(r, np.float64)
    return scaled(out.reshape(-1, DIM)[: len(words)])


def features(texts: list[bytes], words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, POOLS * DIM): mean and deviation of each text's word vectors and the size of their steps; zeros without words."""
    out = np.zeros((len(texts), POOLS * DIM), np.float32)
    for a, w, h in _pieces(texts):
        if not len(h):
            continue
        keys, back = np.unique(h, return_inverse=True)
        row, (p, q, sign) = find(words, keys), index_vectors(keys)
        x, new = np.zeros((len(keys), DIM), np.float32), np.flatnonzero(row < 0)
        x[row >= 0] = vectors[row[row >= 0]]
        np.add.at(x, (new, p[new]), sign[new] * 0.5**0.5)
        np.add.at(x, (new, q[new]), -sign[new] * 0.5**0.5)
        x = x[back]
        some = np.flatnonzero(w.counts)
        at, n = w.first[:-1][some], w.counts[some, None]
        mean = np.add.reduceat(x, at, axis=0) / n
        square = np.add.reduceat(x * x, at, axis=0) / n
        step = np.zeros_like(x)
        step[:-1] = x[1:] - x[:-1]
        step[w.first[1:][some] - 1] = 0
        steps = np.add.reduceat(step * step, at, axis=0) / np.maximum(n - 1, 1)
        out[a + some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.sqrt(steps)], 1)
    return out


class Network:
    """Two layers on standardised features, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.temperature = 1.0
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.rate = (y.sum() + 1) / (len(y) + 2)
        self.constant = len(y) < 20 or y.min() == y.max()
        if self.constant:
            return
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        cut = rng.random(len(y)) < 0.2
        p = [rng.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, t = [0 * a for a in p], [0 * a for a in p], 0
        train = np.flatnonzero(~cut)
        for _ in range(max(EPOCHS, 2000 * 128 // (20 * len(train) + 1))):
            order = rng.permutation(train)
            for a in range(0, len(order), 128):
                at = order[a : a + 128]
                h = np.tanh(z[at] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logit = self.logit(x[cut])
        loss = lambda k: np.logaddexp(0, np.where(y[cut] > 0, -1, 1) * logit / k).mean() if len(logit) else k
        self.temperature = min(np.geomspace(0.5, 8, 41), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), float(self.rate))
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, words: np.ndarray, vectors: np.ndarray, label: str, folds: int, fold: int, id_col: str, text_col: str, sample: int) -> Network:
    """The network, from sample labelled rows at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("known"), F.col(label).cast("int").alias("label")).where("known is not null and label is not null").where(~held_out(F.col("known"), folds, fold))
    known = known.groupBy("known").agg(F.min("label").alias("label")).orderBy(F.xxhash64("known"), "known").limit(sample)
    taught = docs.select(docs[id_col].cast("long").alias("known"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), "known").select("label", "text")
    held = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def examples(batches):
        for batch in batches:
            x = features(_texts(batch.column(1)), *held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    rows = taught.mapInArrow(examples, "y int, x binary").toArrow()  # of sample labels at most
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"].to_pylist()]) if rows.num_rows else np.zeros((0, POOLS * DIM), np.float32)
    y = rows["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:8], y)) if len(y) else np.zeros(0, np.int64)
    return Network(x[order].astype(np.float64), y[order])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = 0, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with _held_out, _score (0 to 1) and _predicted (1 where the score reaches the threshold).

    Null and empty texts are scored as texts without words. Labels that are null, of held-out ids or of ids without a document teach nothing; an id labelled twice has the smaller
    label. With fewer than 20 usable labels, or one class only, every score is the (smoothed) rate of label 1. A null id is not held out. Repeated rows are scored alike, extra columns of docs are
    passed on, but for those named _held_out, _score or _predicted, which give way. An empty table gives an empty result.
    """
    docs = docs.drop("_held_out", "_score", "_predicted")
    words = vocabulary(docs, text_col)
    vectors = word_vectors(docs, words, text_col)
    network = fitted(docs, labels, words, vectors, label, folds, fold, id_col, text_col, sample)
    model = docs.sparkSession.sparkContext.broadcast((words, vectors, network))
    at, names = docs.columns.index(text_col), [*docs.columns, "_score"]

    def score(batches):
        words, vectors, network = model.value
        for batch in batches:
            s = network.score(features(_texts(batch.column(at)), words, vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=names)

    out = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))
    return out.withColumns({"_held_out": held_out(F.col(id_col), folds, fold), "_predicted": F.when(F.col("_score") >= threshold, 1).otherwise(0)})


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
