"""A training-data pipeline over the documents table: five stages, each a function of (spark, docs, sf_dir).

Every stage takes what the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, common, jaccard_join, mixing, quality, substring_dedup


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns but the text, whatever their names), doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, some of them new."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below its threshold) go.

    Null and empty texts are scored like others; repeated rows and null ids go or stay by their text. Other columns, of any name, are kept. Without labels every document has
    the same score. An empty table gives an empty one.
    """
    scored = quality.score_quality(packed(docs), common.read(spark, sf_dir, "labels"))
    return unpacked(scored.where("_predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by shingle similarity, directly or through others, that of the smallest id stays, once.

    Documents without shingles stay; of rows that agree in id and text one stays. Rows of a null id link by their texts; one of a group stays only if no row of
    the group has an id. Other columns, of any name, are kept. An empty table gives an empty one.
    """
    common.prepare(spark)
    classes = jaccard_join.jaccard_components(docs, common.scratch(spark), keys=True)
    kept = classes.where("row_key = component_key").select("row_key").distinct()
    rows = packed(docs).withColumns({"row_key": jaccard_join.row_key(F.col("doc_id"), F.col("text")), "hash": F.xxhash64("text")})
    return unpacked(rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key", "hash"]), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go; a text that loses some is its other words joined by one space. Rows stay, even with no word left.

    Null texts stay null; repeated rows of 35 words or more lose all they share. Other columns, of any name, are kept. An empty table gives an empty one.
    """
    common.prepare(spark)
    cut = substring_dedup.remove_repeats(packed(docs), common.scratch(spark))
    lost = F.col("_n_removed") > 0
    new = {"text": F.when(lost, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.char_length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(cut, docs, **new)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have no words and null sources are one source; ids may be null or repeated. Other columns, of any name, are kept. An empty table gives an empty one.
    """
    common.prepare(spark)
    return mixing.emit(docs, common.scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row for each copy in the mix; a null text has no tokens. Empty in, empty out."""
    common.prepare(spark)
    return bpe.encode(docs, common.scratch(spark), outputs=("ids_sha256", "decoded_sha256"))


STAGES = [("quality", filter_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mixing", mix), ("bpe", encode)]

#: The quality network has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between them, the documents are a table in the shared folder, deleted when the next one stands."""
    docs, folder, last = common.read(spark, sf_dir, "documents"), common.scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), folder, name)
        if last:
            common.drop(spark, folder, last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
