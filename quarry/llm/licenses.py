"""License scans with DataFrame functions only: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are lower-cased (A-Z). A window is WINDOW consecutive 5-word shingles, windows start every WINDOW / 2 shingles; its signature
is the smallest of its shingle hashes under each of BANDS orders, and every band is one of them. A template's windows are cut likewise, from its
own first shingle on, and a template of fewer than WINDOW shingles is one window. A document and a template meet if a window of each agree in a
band.

Collision probability. Windows of Jaccard similarity s agree in some band with probability 1 - (1 - s)**BANDS. A template of WINDOW / 2 shingles or more
that stands whole in a document has, for each of its windows, a document's window that holds at least WINDOW / 2 + 1 of its WINDOW shingles, so s >= 5/11 for WINDOW 8, which
8 bands turn into 0.992 for each window. For a template of m < WINDOW shingles, a document's window holds it whole (m <= WINDOW / 2 + 1) and s >= m / WINDOW;
those short templates would be missed too often at m below 4, so every single shingle is a window of its own as well, in bands of its own, where a template of fewer than
4 shingles offers each of its shingles: there the probability is 1.

Retrieval. The bands' minima of all windows are keys, and a band's number is part of its hash. A bitmap of the templates' keys, BITS for each, leaves a text few of
its own; these are exploded and joined with the table (key, template). Work on a text does not depend on the number of templates. A text and a
template that meet in several keys go on at the first of them only.

Verification counts exactly the template's distinct shingles that the document has: a match is NUM / DEN of them or more.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.license_texts import TEMPLATES

K, WINDOW, BANDS, NUM, DEN, SHORT = 5, 8, 8, 80, 100, 4
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the bitmap for each key of the templates.
BITS = 16
#: Shingles of all templates at most.
MOST = 1 << 16


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(words: str) -> Column:
    """Hashes of K consecutive word hashes, by a window over the array of word hashes."""
    return F.when(
        F.size(words) >= K,
        F.transform(F.sequence(F.lit(1), F.size(words) - (K - 1)), lambda i: F.xxhash64(*[F.element_at(F.col(words), i + j) for j in range(K)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(order: str) -> Column:
    """The smallest hash of every window. order is named twice, lest it be computed again for each window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(order) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))
    return F.when(F.size(order) > 0, F.transform(starts, lambda i: F.array_min(F.slice(order, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _order(band: int):
    return lambda h: F.xxhash64(h, F.lit(band))


def _keyed(df: DataFrame, words: str) -> DataFrame:
    """df with _h (shingle hashes) and _k0 ... (for each band the window minima under its order)."""
    df = df.withColumn("_h", _hashes(words))
    df = df.withColumns({f"_o{band}": F.transform("_h", _order(band)) for band in range(BANDS)})
    return df.withColumns({f"_k{band}": _minima(f"_o{band}") for band in range(BANDS)})


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and template that match: id_col, license, n_found, n_shingles, first_word.

    n_shingles: the template's distinct shingles; n_found: how many of them the document has; first_word: the number (from 1) of the first
    word of the document's first shingle of the template's. Null and empty texts and texts of fewer than K words match nothing, nor do templates of fewer than K words.
    A null id stays null; repeated rows give repeated matches. Other columns play no part. An empty table gives an empty result. Templates are
    a parameter, MOST shingles at most: their table is broadcast.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    t = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    rows = _keyed(t.withColumn("_words", word_hashes(F.col("body"))), "_words").collect()  # the templates
    offers = [(r["license"], sorted(set(r["_h"])), set(r["_h"] if len(set(r["_h"])) < SHORT else []).union(*(r[f"_k{b}"] for b in range(BANDS)))) for r in rows if r["_h"]]
    if sum(len(h) for _, h, _ in offers) > MOST:
        raise ValueError(f"templates of more than {MOST} shingles")
    keys = sorted((x, name, h, sorted(k)) for name, h, k in offers for x in k)
    table = spark.createDataFrame(keys, "key long, license string, own array<long>, offered array<long>")
    bits = max(10, (BITS * len(keys)).bit_length())
    words = [0] * (1 << (bits - 6))
    for x, *_ in keys:
        at = x & ((1 << bits) - 1)
        words[at >> 6] |= 1 << (at & 63)
    known = F.lit([w - (1 << 64) if w >> 63 else w for w in words]).cast("array<bigint>")
    bit = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    held = lambda x: F.getbit(F.get(known, F.shiftright(bit(x), 6).cast("int")), bit(x).bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
    d = _keyed(docs.select(docs[id_col].alias("_id"), word_hashes(docs[text_col].cast("string")).alias("_words")), "_words")
    d = d.select("_id", "_h", F.array_distinct(F.concat(*[F.filter(c, held) for c in ["_h", *(f"_k{b}" for b in range(BANDS))]])).alias("_met"))
    d = d.select("_id", "_h", "_met", F.explode(F.when(F.size("_met") > 0, F.col("_met"))).alias("key"))  # not of the column itself: a filter on it would be pushed down and compute the bands twice
    d = d.join(F.broadcast(table), "key").where(F.get(F.filter("_met", lambda x: F.array_contains("offered", x)), F.lit(0)) == F.col("key"))
    first = F.array_min(F.filter(F.transform("own", lambda x: F.array_position("_h", x)), lambda p: p > 0))
    d = d.select("_id", "license", F.size(F.array_intersect("_h", "own")).alias("n"), F.size("own").alias("of"), first.alias("first")).where(DEN * F.col("n") >= NUM * F.col("of"))
    return d.select(F.col("_id").alias(id_col), "license", F.col("n").cast("long").alias("n_found"), F.col("of").cast("long").alias("n_shingles"), F.col("first").cast("long").alias("first_word"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    cut = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    grams = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END"
    return f"""
WITH t AS (SELECT license, list_distinct({grams}) AS g FROM (SELECT license, {cut.format("body")} AS w FROM (VALUES {values}) v(license, body))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {cut.format("text")} AS w FROM documents)),
m AS (SELECT doc_id, license, len(list_filter(t.g, lambda x: list_contains(d.g, x))) AS n_found, len(t.g) AS n_shingles,
      list_min(list_filter(list_transform(t.g, lambda x: list_position(d.g, x)), lambda p: p > 0)) AS first_word FROM d, t)
SELECT doc_id, license, n_found::BIGINT AS n_found, n_shingles::BIGINT AS n_shingles, first_word::BIGINT AS first_word FROM m WHERE 100 * n_found >= 80 * n_shingles AND n_shingles > 0
"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {"op2_license_scan": _sql()}
