"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size. Each is expected target / source size times; the prefix sum of these
expectations, from one offset of the source, crosses an integer once for every copy that the mix takes of the document.
Ordering by size spreads the copies over all sizes, so that the words taken come near the target.

The prefix sum needs no task to see a whole source: rows are range partitioned by (source, size, id), numbered inside
their partition, and the partitions' counts per source (at most one row for each partition and source) are summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
WORD = r"[^\x20\x09-\x0D]+"
_LOW = (1 << 33) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def numbered(df: DataFrame, keys: Sequence[Column], folder: str, name: str) -> DataFrame:
    """df as a table in order of keys, with _at: the partition's number times 2**33 plus the row's place in it."""
    return common.table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), folder, name)


def targets(sizes: DataFrame, folder: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of the rows of sizes (_s, _null, _source_size): weights by code point order of the sources, null last.

    The level is raised until no target is above cap times its source: each round is one aggregation over the sources.
    """
    order = [F.col("_null"), F.col("_s")]
    t = numbered(sizes, order, folder, "sources").withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = t.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW))) % len(weights)
    t = t.join(before, "_part").withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")))
    t = common.table(t.select("_s", "_null", "_source_size", "_w"), folder, "weights")
    full = F.col("_source_size") * cap
    first = t.agg(F.sum("_source_size"), F.sum("_w")).first()
    total, level = share * float(first[0] or 0), 0.0
    if total:
        level, was = total / float(first[1]), -1.0
        while level != was:
            over = full <= F.col("_w") * level
            r = t.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("_w")))).first()
            was = level
            level = (total - float(r[0] or 0)) / float(r[1]) if r[1] else level
    return t.withColumn("_target", F.least(full, F.col("_w") * F.lit(level)))


def mix_sources(
    docs: DataFrame, folder: str, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None
) -> DataFrame:
    """The rows of docs with _size, _source_size, _target and _copies (how often the mix takes the row, 0 to ceil(cap)).

    A null text has size 0, a null source is a source of its own, the last one; null ids and repeated rows are rows like
    any other. Rows of one source and size are ordered by id; rows that agree in these may swap copies. Sources without words have target 0 and
    none of their documents is taken. size, where given, stands for the words of the text. An empty table gives an empty result. docs may have any other columns;
    those of the result's names give way.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies")
    s, null = F.coalesce(F.col(source_col), F.lit("")), F.col(source_col).isNull()
    d = docs.select(F.struct("*").alias("_row"), s.alias("_s"), null.alias("_null"), F.col(id_col).alias("_id"), (word_count(F.col(text_col)) if size is None else size).alias("_size"))
    d = numbered(d, [F.col("_null"), F.col("_s"), F.col("_size"), F.col("_id")], folder, "sized").withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = d.groupBy("_null", "_s", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"), F.sum("_size").alias("_sum"))
    parts = common.table(parts, folder, "parts")
    earlier = Window.partitionBy("_null", "_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts_at = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    t = targets(parts.groupBy("_null", "_s").agg(F.sum("_sum").alias("_source_size")), folder, weights, share, cap)
    places = common.table(parts_at.join(t, ["_null", "_s"]).select("_null", "_s", "_part", (F.col("_before") - F.col("_from")).alias("_shift"), "_source_size", "_target"), folder, "places")
    d = d.join(places, ["_null", "_s", "_part"])
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    u, rank = offset(F.when(~F.col("_null"), F.col("_s")), seed), F.col("_at") + F.col("_shift")
    copies = F.least(F.floor((rank + 1) * rate + u) - F.floor(rank * rate + u), F.ceil(F.lit(cap)))
    return d.select("_row.*", "_size", "_source_size", "_target", copies.cast("long").alias("_copies"))


def emit(docs: DataFrame, folder: str, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    given = {c: docs[options.pop(c, d)].alias(d) for c, d in (("id_col", "doc_id"), ("source_col", "source"))}
    size = options.pop("size", None)
    size = word_count(docs[options.pop("text_col", "text")]) if size is None else size
    kept = docs.select(F.struct("*").alias("_row"), *given.values(), size.alias("words"))
    mixed = mix_sources(kept, folder, size=F.col("words"), **options).where("_copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix_sources(common.table(docs, folder, "words"), folder, size=F.col("words"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), "source")


QUERIES = {"op10_mixing": op10_mixing}

ORACLES = {
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source IS NULL, source) AS k FROM w),
p AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(1.5 * source_size) OVER () AS total FROM r),
l AS (SELECT (total - full_before) / w_left AS level FROM p WHERE (total - full_before) / w_left < 2 * source_size / w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(2 * source_size, w * (SELECT level FROM l)) AS target,
      ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM w),
n AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.target / t.source_size AS rate, t.u,
      (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (floor((i + 1) * rate + u) - floor(i * rate + u)))::BIGINT AS taken,
       (floor((i + 1) * rate + u) - floor(i * rate + u))::BIGINT AS copies, source FROM n
""",
}
