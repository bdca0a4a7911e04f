"""Exact top-k search by integer inner product over a pivot-distance index.

Inner products become distances: with M the largest squared norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0),
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest x' have the largest inner products, and the triangle inequality holds.

Index. Pivots are PIVOTS of the vectors, taken from a sample of PIVOT_SAMPLE rows (the smallest hashes of vec_id): they only shape
the index. Every vector is keyed by its nearest pivot and its distance from it; each pivot's vectors, sorted by distance, are cut
into annuli (blocks of BLOCK rows at most, with their least and greatest distance).

Search. First each query visits the annuli of its nearest pivot that lie next to its own distance (the first ring of the
expansion), which gives k scores to beat. Then it goes to every other annulus that the bounds leave open: with d the distance from
the query to the pivot, an annulus [lo, hi] has no point nearer than max(d - hi, lo - d), and no other pivot's cell has a point nearer than (d - d_nearest) / 2. Where that
can't beat the k-th score, the expansion has stopped. Queries travel to annuli in groups, an annulus is scored as one integer product, and
each (group, annulus) returns k rows a query at most.

What the bounds can do depends on the data alone: vectors on few dimensions or in tight clusters leave most annuli out, unit vectors spread over 64 dimensions
leave hardly any (README has the measured shares).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

TOP, SCALE, EVERY = 5, 256, 50
PIVOTS, PIVOT_SAMPLE, BLOCK, GROUP = 32, 4096, 512, 256
#: Rings of one pivot's range of distances; an annulus lies in one ring.
RINGS = 64
#: Rings of the nearest pivot that a query visits first.
FIRST = 3
#: Room for rounding in the bounds, relative to the largest norm: distances are doubles, scores are exact.
SLACK = 1e-6
#: Scores beyond are given as this.
MOST = 2.0**62


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v: the scaled integer components of the vectors that take part."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    return df.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the lists as floats that hold integers exactly, shorter ones filled up with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), width))
    if len(flat):
        out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _pivots(vectors: DataFrame, width: int) -> np.ndarray:
    """Spread out members of the sample, each the farthest from those before it."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()
    x = _matrix(rows["v"].combine_chunks(), width)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def search(vectors: DataFrame, queries: DataFrame, folder: str, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors of another id with the largest score.

    Score: inner product of floor(256 * component), exact while it stays below 2**53, of any size up to 2**62, where it is cut. Ties go to the smaller vec_id. Vectors that are null, or hold null
    or non-finite components, and rows of a null id take no part. Shorter vectors count as filled up with zeros. Repeated rows
    are found as often as they stand there; a query gets all other rows if there are fewer than k. A query id that occurs twice is one query for each row of it that
    differs. Other columns play no part. An empty table gives an empty result.
    stats: gets visited_share, the share of all (query, vector) pairs that were scored.
    """
    spark = vectors.sparkSession
    x = common.table(_valid(vectors, id_col, vec_col), folder, "vectors")
    q = _valid(queries, id_col, vec_col).distinct()
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda t, y: t + y.cast("double") * y.cast("double"))
    width, most = x.agg(F.max(F.size("v")), F.max(norm)).first()
    width, most = int(width or 0), float(most or 0)
    if not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = _pivots(x, width)
    ring_width = 2 * np.sqrt(most) / RINGS + 1e-9
    known = spark.sparkContext.broadcast(pivots)  # PIVOTS rows

    def distances(m: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """From (m, rest) to the pivots' own places (p, sqrt(M - |p|^2))."""
        p = known.value
        tail = np.sqrt(np.maximum(most - (p * p).sum(1), 0))
        return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * m @ p.T + (rest[:, None] - tail[None]) ** 2, 0))

    def key(batches):
        for batch in batches:
            m = _matrix(batch.column(1), width)
            d = distances(m, np.sqrt(np.maximum(most - (m * m).sum(1), 0)))
            near = d.argmin(1)
            own = d[np.arange(len(m)), near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(own), pa.array((own / ring_width).astype(np.int32))], names=["id", "v", "pivot", "d", "ring"])

    keyed = x.mapInArrow(key, "id bigint, v array<bigint>, pivot int, d double, ring int")

    def block(batches):
        """Sorted rows into annuli of at most BLOCK rows of one pivot and ring."""
        for batch in batches:
            tag = batch.column("pivot").to_numpy().astype(np.int64) * (RINGS + 2) + batch.column("ring").to_numpy()
            cut = np.flatnonzero(np.diff(tag, prepend=-1))
            cut = np.unique(np.concatenate([cut, *(np.arange(a, b, BLOCK) for a, b in zip(cut, np.append(cut[1:], len(tag)), strict=True))]))
            d, m = batch.column("d").to_numpy(), _matrix(batch.column("v"), width).astype(np.float64)
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(tag)).tolist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("pivot")[a].as_py()], pa.int32()), pa.array([batch.column("ring")[a].as_py()], pa.int32()), pa.array([d[a:b].min()]), pa.array([d[a:b].max()]), pa.array([batch.column("id").to_numpy()[a:b].tobytes()], pa.binary()), pa.array([m[a:b].tobytes()], pa.binary())],
                    names=["pivot", "ring", "lo", "hi", "ids", "rows"],
                )

    annuli = keyed.repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id").mapInArrow(block, "pivot int, ring int, lo double, hi double, ids binary, rows binary")
    annuli = common.table(annuli.withColumn("block", F.monotonically_increasing_id()), folder, "annuli")
    rings = annuli.groupBy("pivot", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def place(batches):
        """A row for each query and pivot: the query's distance from the pivot and from its nearest one."""
        for batch in batches:
            m = _matrix(batch.column(1), width)
            d = distances(m, np.zeros(len(m)))
            n, p = d.shape
            at = np.repeat(np.arange(n), p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(d.ravel()), pa.array(d.min(1)[at]), pa.array((m * m).sum(1)[at])], names=["id", "v", "pivot", "dq", "least", "norm"])

    placed = common.table(q.mapInArrow(place, "id bigint, v array<bigint>, pivot int, dq double, least double, norm double"), folder, "queries")

    def score(visits: DataFrame) -> DataFrame:
        """The k best of each visited annulus. visits: id, v, block."""
        parts = visits.groupBy("block").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        grouped = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        grouped = grouped.groupBy("block", "part").agg(F.collect_list(F.struct("id", "v")).alias("qs"))

        def run(batches):
            for batch in batches:
                for qs, ids, rows in zip(batch.column("qs"), batch.column("ids"), batch.column("rows"), strict=True):
                    ids = np.frombuffer(ids.as_buffer(), np.int64)
                    m = np.frombuffer(rows.as_buffer(), np.float64).reshape(len(ids), width)
                    qid, qm = qs.values.field(0).to_numpy(), _matrix(qs.values.field(1), width)
                    s = qm @ m.T
                    s[qid[:, None] == ids[None]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    best = np.take_along_axis(s, order, 1)
                    keep = np.isfinite(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(1))), pa.array(np.repeat(np.arange(len(qid)), keep.sum(1)).astype(np.int32)), pa.array(ids[order][keep]), pa.array(np.clip(best[keep], -MOST, MOST).astype(np.int64)), qs.values.field(1).take(pa.array(np.repeat(np.arange(len(qid)), keep.sum(1))))], names=["id", "n", "vec_id", "score", "v"])

        return grouped.join(annuli.select("block", "ids", "rows"), "block").select("qs", "ids", "rows").mapInArrow(run, "id bigint, n int, vec_id bigint, score bigint, v array<bigint>").drop("n")

    near = placed.where("dq = least").withColumn("ring", (F.col("dq") / ring_width).cast("int"))
    nearest = Window.partitionBy("id", "v", "pivot").orderBy(F.abs(F.col("r") - F.col("ring")), "r")
    near = near.join(rings.select("pivot", F.col("ring").alias("r")), "pivot").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= FIRST)
    near = near.select("id", "v", "pivot", F.col("r").alias("ring"))
    seen = near.join(annuli.select("pivot", "ring", "block"), ["pivot", "ring"]).select("id", "v", "block")
    seen = common.table(seen, folder, "first-visits")
    first = common.table(_best(score(seen), k), folder, "first")
    bound = first.groupBy("id", "v").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    open_ = placed.join(bound, ["id", "v"], "left").withColumn("reach", F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(F.col("norm") + F.lit(most) - 2 * F.col("kth"), F.lit(0.0))) + SLACK * (1 + most**0.5)))
    open_ = open_.where(F.col("kth").isNull() | ((F.col("dq") - F.col("least")) / 2 <= F.col("reach")))
    open_ = open_.join(rings, "pivot").where(F.col("kth").isNull() | (F.greatest(F.col("dq") - F.col("hi"), F.col("lo") - F.col("dq")) <= F.col("reach")))
    visits = open_.select("id", "v", "dq", "reach", "pivot", "ring").join(annuli.select("pivot", "ring", "block", "lo", "hi"), ["pivot", "ring"])
    visits = visits.where(F.col("reach").isNull() | (F.greatest(F.col("dq") - F.col("hi"), F.col("lo") - F.col("dq")) <= F.col("reach"))).select("id", "v", "block").join(seen, ["id", "v", "block"], "left_anti")
    if stats is not None:
        rows = annuli.select("block", (F.length("ids") / 8).alias("n"))
        done = seen.select("id", "block").unionAll(visits.select("id", "block")).join(rows, "block").agg(F.sum("n")).first()[0]
        stats["visited_share"] = float(done or 0) / max(x.count() * q.count(), 1)
    both = _best(first.drop("rank").unionByName(score(visits)), k)
    return both.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "v").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "v", "vec_id", "score", "rank")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(f"vec_id % {EVERY} = 0"), common.scratch(spark))


QUERIES = {"op3_topk_search": op3_topk_search}
ORACLES = {
    "op3_topk_search": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM x q JOIN x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""",
}
