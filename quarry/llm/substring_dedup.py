"""Removal of repeated 35-word passages through a compacted de Bruijn graph.

The graph's edges are the windows of 35 consecutive words, its nodes the 34-word overlaps. An edge is repeated when its words
start at two places. Counting every edge would shuffle every word of the corpus; the paths are compacted first:

1. In each window the smallest hash of its 28 eight-word grams (the leftmost of equal ones) is its anchor. Consecutive windows
   with one anchor form a nonbranching path, cut by content alone: repeated text has the same paths, except where a
   repeat begins or ends. A document sends one row for each distinct (anchor, path), about one for 14 words; path is the
   hash of all its words.
2. Spark puts the rows of an anchor together. A path that occurs twice is repeated with all its edges. An anchor with one
   occurrence is unique with all its windows. Only an anchor that has several different paths branches: its paths are expanded.
3. For those, the documents send their edges (anchor, hash of the 35 words), once for each distinct edge of a document and, of
   a repeated path, from the document of the smallest id only. Edges that occur twice are repeated.
4. The marks go back to their documents by id, where they hold at the source coordinates: a mark is the hash of the very words
   it covers, found again in the text, so that it can't hit another passage. Covered words are removed.

Keys that decide are pairs of 64-bit hashes (anchor and path, anchor and edge).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, textkit

SPAN, GRAM = 35, 8
U = textkit.U
_Q = 0x9E3779B97F4A7C15
_QI = pow(_Q, -1, 1 << 64)
SOLID, CHECK, OFFER = 1, 2, 3


class Paths:
    """Windows and paths of some texts: window i covers words begin[i] ... begin[i] + span - 1 and belongs to path of[i]."""

    def __init__(self, texts: list[bytes], span: int = SPAN, gram: int = GRAM):
        self.words = w = textkit.Words(texts)
        h, n = w.hashes(), len(w.starts)
        self.doc = np.repeat(np.arange(len(texts)), w.counts)
        self.span = span
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(_Q), U)]))
            self._inverse = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(_QI), U)]))
            self._sums = np.concatenate([np.zeros(1, U), np.cumsum(h * power[:n], dtype=U)])
        left = w.first[1:][self.doc] - np.arange(n) if n else np.zeros(0, np.int64)
        self.begin = at = np.flatnonzero(left >= span)
        if not len(at):
            self.head = self.tail = self.of = np.zeros(0, np.int64)
            self.anchor = self.path = np.zeros(0, U)
            return
        g = self.hash(np.arange(n - gram + 1), np.full(n - gram + 1, gram))
        low, size, need = g, 1, span - gram + 1
        while 2 * size <= need:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (need - size)], low[need - size :])
        v = low[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (self.doc[at[1:]] != self.doc[at[:-1]]) | (v[1:] != v[:-1]) | (g[at[1:] - 1] == v[:-1])
        self.of = np.cumsum(cut) - 1
        self.head = np.flatnonzero(cut)
        self.tail = np.append(self.head[1:], len(at))
        self.anchor = v[self.head]
        self.path = self.hash(at[self.head], at[self.tail - 1] + span - at[self.head])

    def hash(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of the words begin ... begin + length - 1."""
        with np.errstate(over="ignore"):
            return textkit.mix((self._sums[begin + length] - self._sums[begin]) * self._inverse[begin] + length.astype(U) * U(0xD6E8FEB86659FD93))

    def edges(self) -> np.ndarray:
        return self.hash(self.begin, np.full(len(self.begin), self.span))


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the given columns, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    cols = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.diff(np.append(at, len(order)))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _paths(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), _bytes(batch.column(1))
            for a, b in textkit.groups([len(t) for t in texts]):
                p = Paths(texts[a:b], span, gram)
                (d, anchor, path), n = _distinct(p.doc[p.begin[p.head]], p.anchor, p.path)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][d]), _signed(anchor), _signed(path), pa.array(n.astype(np.int32))], names=["id", "anchor", "path", "n"])

    return docs.mapInArrow(run, "id bigint, anchor bigint, path bigint, n int")


def _edges(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Edges of the marked paths. docs: id, text, marks."""

    def run(batches):
        for batch in batches:
            ids, texts, marks = batch.column(0).to_numpy(), _bytes(batch.column(1)), batch.column(2).to_pylist()
            for a, b in textkit.groups([len(t) for t in texts]):
                p = Paths(texts[a:b], span, gram)
                if not len(p.begin):
                    continue
                kind = _kinds(p, marks[a:b])
                use = kind[p.of] > 0
                (d, anchor, edge, k), n = _distinct(p.doc[p.begin[use]], p.anchor[p.of[use]], p.edges()[use], kind[p.of[use]])
                out = pa.RecordBatch.from_arrays([pa.array(ids[a:b][d]), _signed(anchor), _signed(edge), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "anchor", "edge", "kind", "n"])
                for c in range(0, out.num_rows, 1 << 16):
                    yield out.slice(c, 1 << 16)

    return docs.mapInArrow(run, "id bigint, anchor bigint, edge bigint, kind int, n int")


def _kinds(p: Paths, marks: list) -> np.ndarray:
    """The kind of each path, 0 where its document has no mark for it."""
    kind, d = np.zeros(len(p.head), np.int64), p.doc[p.begin[p.head]]
    for i, m in enumerate(marks):
        if m:
            at = slice(*np.searchsorted(d, [i, i + 1]))
            known = {x["mark"]: x["kind"] for x in m}
            kind[at] = [known.get(x, 0) for x in p.path[at].view(np.int64).tolist()]
    return kind


def _removed(p: Paths, marks: list) -> np.ndarray:
    """Which words of the texts a repeated window covers."""
    gone = np.zeros(len(p.words.starts) + 1, np.int64)
    d = p.doc[p.begin]
    edges = None
    for i, m in enumerate(marks):
        if not m:
            continue
        lo, hi = np.searchsorted(d, [i, i + 1])
        if lo == hi:
            continue
        if edges is None:
            edges = p.edges()
        solid = np.array([x["mark"] for x in m if x["kind"] == SOLID], np.int64)
        single = np.array([x["mark"] for x in m if x["kind"] == CHECK], np.int64)
        hit = np.isin(p.path[p.of[lo:hi]].view(np.int64), solid) | np.isin(edges[lo:hi].view(np.int64), single)
        at = p.begin[lo:hi][hit]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + p.span, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, folder: str, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The rows of docs with _n_words, _n_removed, _kept_sha256 and, if with_text, _kept: the words left, joined by one space.

    A null or empty text has no words: 0, 0, the hash of nothing, and an empty _kept. Texts of fewer than span words keep all. A null id is allowed, and so
    are rows that share an id: each row is a text of its own, so that repeated rows of span words or more remove each other. Other columns are
    passed on, but for those of the result's names, which give way. An empty table gives an empty result.
    """
    docs = docs.drop("_n_words", "_n_removed", "_kept_sha256", "_kept")
    key, held = common.fresh(docs.columns, "_id", "_marks")
    keyed = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))))
    texts = keyed.select(F.col(key).alias("id"), F.col(text_col).cast("string").alias("text"))
    by_path, by_anchor = Window.partitionBy("anchor", "path"), Window.partitionBy("anchor")
    seen = _paths(texts, span, gram).repartition("anchor")
    seen = seen.withColumns({"same": F.sum("n").over(by_path), "owner": F.min("id").over(by_path)})
    seen = seen.withColumns({"all": F.sum("n").over(by_anchor), "branches": F.min("path").over(by_anchor) != F.max("path").over(by_anchor)}).where("all > 1")
    kind = F.when(F.col("same") == 1, CHECK).when(F.col("branches") & (F.col("id") == F.col("owner")), OFFER).otherwise(SOLID)
    marks = common.table(seen.select("id", F.col("path").alias("mark"), kind.alias("kind")).distinct(), folder, "marks")

    grouped = lambda m: m.groupBy("id").agg(F.collect_list(F.struct("mark", "kind")).alias("marks"))
    edges = _edges(texts.join(grouped(marks.where(F.col("kind") != SOLID)), "id").select("id", "text", "marks"), span, gram)
    twice = edges.withColumn("all", F.sum("n").over(Window.partitionBy("anchor", "edge"))).where((F.col("all") > 1) & (F.col("kind") == CHECK))
    single = common.table(twice.select("id", F.col("edge").alias("mark"), "kind").distinct(), folder, "edges")

    final = marks.where(F.col("kind") != CHECK).select("id", "mark", F.lit(SOLID).alias("kind")).unionAll(single)
    d = keyed.join(grouped(final).select(F.col("id").alias(key), F.col("marks").alias(held)), key, "left").select(*[keyed[c] for c in docs.columns], held)
    extra = [("_n_words", T.LongType()), ("_n_removed", T.LongType()), ("_kept_sha256", T.StringType()), *([("_kept", T.StringType())] if with_text else [])]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in extra)])
    at, keep = docs.columns.index(text_col), len(docs.columns)
    names = [*docs.columns, *(n for n, _ in extra)]

    def run(batches):
        for batch in batches:
            texts, marks = _bytes(batch.column(at)), batch.column(keep).to_pylist()
            n_words, n_removed, sha, kept = [], [], [], []
            for a, b in textkit.groups([len(t) for t in texts]):
                p = Paths(texts[a:b], span, gram)
                gone, w = _removed(p, marks[a:b]), p.words
                some = marks[a:b]
                for i in range(b - a):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    words = texts[a + i].split()
                    out = gone[lo:hi]
                    if some[i] and out.any():
                        words = [words[j] for j in np.flatnonzero(~out).tolist()]
                    text = b" ".join(words)
                    n_words.append(hi - lo), n_removed.append(int(out.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *arrays], names=names)

    return d.mapInArrow(run, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, common.scratch(spark), with_text=False)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM x),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM g JOIN r USING (h), (SELECT unnest(range(0, 35)) AS j)),
n AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda t, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
""",
}
