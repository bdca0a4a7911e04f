"""Near-duplicate vectors by Euclidean p-stable hashing, followed by exact cosine checks.

A hash of a normalised vector x is floor((a.x + b) / WIDTH) with a Gaussian and b uniform; K hashes make the bucket of one of L
tables. For unit vectors the cosine fixes the distance, so the chance that one hash agrees is known: K is chosen so that a bucket
holds about BUCKET unrelated vectors at the table's size, and L so that a pair at the threshold meets in some table with probability 1 - MISS.

Equal vectors are one class first, so a third of all rows with one vector cost one row. A bucket of more than PART rows is split into parts, and each
pair of parts is a cell of its own: no task holds more than two parts. Into its buckets a row goes as its number and a sketch of 64 signs of random projections. A cell keeps
the rows with a partner that differs in FAR signs at most (at the threshold a pair differs in more with probability 1e-6, an unrelated one in so few with 1e-3);
only these few fetch their vectors, so what a table costs in the shuffle does not depend on the vectors' size. Cells return sums and a spanning set of links, never all
pairs. A pair that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

COSINE = 0.95
WIDTH, BUCKET, MISS, PART = 2.0, 32, 1e-3, 512
#: At the threshold of 0.95, signs differ with probability acos(0.95) / pi = 0.101.
SIGNS, RISK = 64, 1e-6


def agreement(cosine: float, width: float = WIDTH) -> float:
    """The chance that one hash of two unit vectors agrees."""
    r = width / math.sqrt(2 - 2 * cosine)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def settings(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """K and L for so many rows."""
    k = max(4, math.ceil(math.log(max(rows, 1) / BUCKET) / -math.log(agreement(0.0)))) if rows > BUCKET else 4
    return k, math.ceil(math.log(MISS) / math.log(1 - agreement(cosine) ** k))


def far(cosine: float = COSINE) -> int:
    """The number of differing signs that a pair at the threshold exceeds with probability RISK at most."""
    p, tail, d = math.acos(cosine) / math.pi, 1.0, -1
    while tail > RISK:
        d += 1
        tail -= math.comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d)
    return d


class Hasher:
    def __init__(self, width: int, k: int, tables: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.tables = k, tables
        self.a = rng.standard_normal((width, k * tables))
        self.b = rng.uniform(0, WIDTH, k * tables)
        self.c = rng.integers(1, 1 << 62, k, np.int64) | 1
        self.s = rng.standard_normal((width, SIGNS))

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """One number of 64 bits for each row."""
        return np.packbits(unit @ self.s > 0, axis=1).view(np.int64)[:, 0]

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) numbers of 32 bits: the rows' buckets."""
        h = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.k)
        with np.errstate(over="ignore"):
            return (((h + 1024) * self.c).sum(2) >> 16).astype(np.int32)


def _units(column: pa.Array, width: int) -> np.ndarray:
    flat, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), width))
    if len(flat):
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _by_cell(batches, work):
    """work(table, tag, cuts) for whole cells of rows sorted by (t, b, i, j), a few batches at a time."""
    held: list[pa.RecordBatch] = []
    tags = lambda table: np.stack([table[n].to_numpy() for n in ("t", "b", "i", "j")], 1)
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        tag = tags(table)
        cut = np.flatnonzero((tag[1:] != tag[:-1]).any(1)) + 1
        if len(cut):
            yield from work(table.slice(0, int(cut[-1])), tag[: cut[-1]], cut[:-1])
            held = table.slice(int(cut[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield from work(table, tags(table), np.zeros(0, np.int64))


def _spans(tag: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
    return [(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(tag)], strict=True) if b - a > 1]


def _cell(t: int, cross: bool, part: np.ndarray, c: np.ndarray, m: np.ndarray, u: np.ndarray, h: np.ndarray, cosine: float):
    """Links of a cell: per row the number of vectors it links with, and per row the smallest row it is linked with in the end."""
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    if cross:
        hit &= part[:, None] != part[None]
    i, j = np.nonzero(hit)
    if t:
        seen = (h[i, :t] == h[j, :t]).any(1)
        i, j = i[~seen], j[~seen]
    links = np.bincount(i, m[j], len(c)).astype(np.int64)
    low = c.copy()
    while len(i):
        was = low.copy()
        np.minimum.at(low, i, low[j])
        if (was == low).all():
            break
    return links, low


def near_duplicates(vectors: DataFrame, folder: str, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept (id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: 0 links, their own component, kept.
    Shorter vectors count as filled up with zeros. Rows of equal vectors link with each other, those of one id too. A null id is a row like others, but never names a component;
    it is kept if its component has no other name. Other columns play no part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vec_col].dataType.containsNull)
    v = F.col(vec_col) if single else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    x = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) < float("inf"))) & F.exists("v", lambda y: y != 0)
    x = x.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    x = common.table(x, folder, "vectors")
    classes = x.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("m")).withColumn("c", F.monotonically_increasing_id())
    classes = common.table(classes, folder, "classes")
    rows, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    k, tables = settings(rows, cosine)
    hasher = spark.sparkContext.broadcast(Hasher(int(width or 1), k, tables))
    width = int(width or 1)

    most = far(cosine)

    def buckets(batches):
        for batch in batches:
            unit = _units(batch.column(1), width)
            b, n = hasher.value.buckets(unit), len(unit)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(b.ravel()), pa.array(np.repeat(hasher.value.signs(unit), tables))], names=["c", "t", "b", "s"])

    keys = common.table(classes.select("c", "v").mapInArrow(buckets, "c bigint, t int, b int, s bigint"), folder, "keys")
    full = keys.groupBy("t", "b").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    cells = keys.join(full, ["t", "b"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("t", "b", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "c", "s")
    cells = cells.repartition("t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j")

    def sift(batches):
        def work(table, tag, cut):
            s, part, keep = table["s"].to_numpy().view(np.uint64), table["part"].to_numpy(), np.zeros(len(tag), bool)
            for a, b in _spans(tag, cut):
                near = np.bitwise_count(s[a:b, None] ^ s[None, a:b]) <= most
                np.fill_diagonal(near, False)
                if tag[a, 2] != tag[a, 3]:
                    near &= part[a:b, None] != part[None, a:b]
                keep[a:b] = near.any(1)
            yield from table.select(["t", "b", "i", "j", "part", "c"]).filter(pa.array(keep)).combine_chunks().to_batches()

        yield from _by_cell(batches, work)

    kept = common.table(cells.mapInArrow(sift, "t int, b int, i int, j int, part int, c bigint"), folder, "kept")
    kept = kept.join(classes.select("c", "m", "v"), "c").repartition("t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j").select("t", "b", "i", "j", "part", "c", "m", "v")

    def link(batches):
        def work(table, tag, cut):
            u = _units(table["v"].combine_chunks() if table["v"].num_chunks != 1 else table["v"].chunk(0), width)
            h = hasher.value.buckets(u)
            part, c, m = (table[n].to_numpy() for n in ("part", "c", "m"))
            for a, b in _spans(tag, cut):
                links, low = _cell(int(tag[a, 0]), tag[a, 2] != tag[a, 3], part[a:b], c[a:b], m[a:b], u[a:b], h[a:b], cosine)
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:b][some]), pa.array(links[some]), pa.array(low[some])], names=["c", "links", "low"])

        yield from _by_cell(batches, work)

    found = common.table(kept.mapInArrow(link, "c bigint, links bigint, low bigint"), folder, "links")
    common.drop(spark, folder, "keys", "kept")
    comp = common.components(found.select(F.col("c").alias("a"), F.col("low").alias("b")), folder)
    named = classes.select("c", "low", "m").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(names, "component").join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left")
    known = known.select("c", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")).join(classes.select("c", "v"), "c")
    out = x.where("v is not null").join(known, "v").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionAll(x.where("v is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"), common.scratch(spark))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES = {
    "op4_embedding_dedup": """
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.root),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(root) AS component_id, r.vec_id = min(root) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
""",
}
