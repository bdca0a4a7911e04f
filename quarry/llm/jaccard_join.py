"""N-gram Jaccard join by rare-first prefix filtering, down to the classes of documents linked directly or through others.

A document is the set of its distinct 5-word shingles; two link when 100 * |A & B| >= 80 * |A | B|. Steps:

1. Every text once: the set's size, a 128-bit fingerprint and the parities of its shingles' numbers in 1024 ranges of their hash.
   Documents with equal sets are one class from here on, held by its smallest id: a thousand copies cost one.
2. Rare first. Each set's first shingles by hash are counted exactly, by a shuffle that grows with the input; those that more than LIST
   sets hold go into a bitmap. The global order is (in the bitmap, hash). Any total order is right for prefix filtering;
   this one puts what many documents share behind what few do, so that lists stay short whatever the input's size.
3. The prefix of a set of n shingles is its first n - ceil(0.8 n) + 1 in that order. Two sets that link share one of them.
   Lists of one document go. Shingles whose lists have the same members become one list that knows how many they are, so that two
   documents meet once for each distinct list and not once for each shingle that they share; lists of one smallest member are
   merged where that makes fewer pairs (live postings).
4. First round: each list pairs its smallest member with each other one, so a list costs its length, not its square.
   Pairs that pass the filters are verified; the links' components are found.
5. Second round: only lists that hold more than one component still matter, and only pairs across components (a list's largest
   component is joined with the rest of the list, never with itself). They pass the length filter, the positional filter (shared prefix shingles and what may follow the last) and the suffix filter (two
   sets differ by a shingle at least wherever their parities do, which bounds the overlap); pairs of the first round are left out, so each pair is verified once.

A link inside one component can't change the components, so leaving those pairs out loses nothing. Verification counts
common 64-bit shingle hashes of both whole sets. jaccard_links gives every link between classes instead, without the
pruning by components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common, textkit

K, NUM, DEN = 5, 80, 100
#: A shingle that more sets hold is frequent; it is counted among the first DEPTH prefixes of a set, and the bitmap of frequent ones has 2**MOST_BITS bits at most.
LIST, DEPTH, MOST_BITS = 16, 2, 25
#: Rows without an id are known by a number from here on, by their text.
UNNAMED = 1 << 62
#: Bits of the filter that spares sets no candidate pair names; its size is fixed, a full one only spares less.
FILTER_BITS = 23
BINS, COARSE = 1024, 4


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode().lower() for x in batch.column(1).to_pylist()]


def _sets(texts: list[bytes], k: int):
    for a, b in textkit.groups([len(t) for t in texts]):
        yield from textkit.shingle_sets(texts[a:b], k)


def prefix_length(n, num: int = NUM, den: int = DEN):
    return n - (num * n + den - 1) // den + 1


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        u = textkit.U
        for batch in batches:
            n, f1, f2, odd = [], [], [], []
            for s in _sets(_texts(batch), k):
                n.append(len(s))
                f1.append(int(textkit.mix(s ^ u(0x5BD1E9955BD1E995)).sum(dtype=u).astype(np.int64)))
                f2.append(int(textkit.mix(s + u(0x27D4EB2F165667C5)).sum(dtype=u).astype(np.int64)))
                odd.append(np.packbits(np.bincount((s >> u(54)).astype(np.int64), minlength=BINS).astype(np.uint8) & 1).view(np.int64))
            flat = pa.array(np.concatenate(odd) if odd else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BINS // 64), pa.int32()), flat)],
                names=["id", "n", "f1", "f2", "odd"],
            )

    return docs.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, odd array<bigint>")


def _parts(docs: DataFrame, schema: str, k: int, pick, columns) -> DataFrame:
    """Some shingles of every set, flat. pick(set): the numbers of those to send; columns(ids, sets, picked): their rows."""

    def run(batches):
        for batch in batches:
            ids, sets = batch.column(0).to_pylist(), list(_sets(_texts(batch), k))
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                sets = [sets[i] for i in some]
                out = columns([ids[i] for i in some], sets, [pick(s) for s in sets])
                for a in range(0, out.num_rows, 1 << 16):
                    yield out.slice(a, 1 << 16)

    return docs.mapInArrow(run, schema)


def _frequent(docs: DataFrame, folder: str, k: int, num: int, den: int) -> np.ndarray:
    """A bitmap of the shingles that more than LIST sets hold, of those in the first DEPTH prefixes of a set by hash.

    It has 16 bits for each of them, 2**MOST_BITS at most: LIST doubles until that holds, so the most frequent are always in it.
    """
    first = lambda s: np.arange(min(len(s), DEPTH * prefix_length(len(s), num, den)))  # sets are sorted by hash
    flat = lambda ids, sets, picked: pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[p] for s, p in zip(sets, picked, strict=True)]).view(np.int64))], names=["token"])
    level = F.floor(F.log2(F.col("n") - 1)).cast("int").alias("level")
    often = _parts(docs, "token bigint", k, first, flat).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > LIST)
    often = common.table(often.select("token", level), folder, "frequent")
    sizes = sorted(((r[0], r[1]) for r in often.groupBy("level").count().collect()), reverse=True)  # 64 rows at most
    least, held = 0, 0
    for level, n in sizes:
        if held and 16 * (held + n) > 1 << MOST_BITS:
            break
        least, held = level, held + n
    bits = min(MOST_BITS, max(12, (16 * held).bit_length()))
    return _bitmap(often.where(F.col("level") >= least).select(F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit")), bits)


def _flagged(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether the bitmap of _frequent has these shingles."""
    bit = tokens & textkit.U(32 * len(words) - 1)
    return (words[(bit >> textkit.U(5)).astype(np.int64)] >> (bit & textkit.U(31)).astype(np.uint32)) & np.uint32(1) == 1


def _postings(docs: DataFrame, frequent, k: int, num: int, den: int) -> DataFrame:
    def pick(s):
        return np.argsort(_flagged(frequent.value, s), kind="stable")[: prefix_length(len(s), num, den)]

    def rows(ids, sets, picked):
        ps = np.array([len(p) for p in picked])
        tokens = np.concatenate([s[p] for s, p in zip(sets, picked, strict=True)])
        pos = np.arange(ps.sum()) - np.repeat(np.cumsum(ps) - ps, ps)
        columns = [tokens.view(np.int64), np.repeat(np.array(ids, np.int64), ps), np.repeat(np.array([len(s) for s in sets], np.int32), ps), pos.astype(np.int32), _flagged(frequent.value, tokens)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "n", "pos", "often"])

    return _parts(docs, "token bigint, id bigint, n int, pos int, often boolean", k, pick, rows)


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))


def _bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the column bit, numbers below 2**bits."""
    words = numbers.select(F.shiftright("bit", 5).alias("w"), F.expr("shiftleft(1L, cast(bit % 32 AS int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2**(bits - 5) at most
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def _named_sets(docs: DataFrame, pairs: DataFrame, folder: str, name: str, k: int) -> DataFrame:
    """(id, set) of the documents whose id the bitmap holds: all that the pairs name, and few others."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    words = docs.sparkSession.sparkContext.broadcast(_bitmap(ids.select(_bit(F.col("id")).alias("bit")), FILTER_BITS))

    def run(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy()
            keep = np.flatnonzero((words.value[bit // 32] >> (bit % 32).astype(np.uint32)) & 1)
            if len(keep):
                some = batch.take(pa.array(keep))
                sets = pa.array([s.tobytes() for s in _sets(_texts(some), k)], pa.binary())
                out = pa.RecordBatch.from_arrays([some.column(0), sets], names=["id", "set"])
                for a in range(0, out.num_rows, 64):
                    yield out.slice(a, 64)

    return common.table(docs.withColumn("bit", _bit(F.col("id"))).mapInArrow(run, "id bigint, set binary"), folder, name)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), textkit.U), np.frombuffer(y.as_buffer(), textkit.U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint").distinct()


def _fits(n1: str, n2: str, odd1: str, odd2: str, num: int, den: int) -> Column:
    """Whether sizes and parities leave room for the overlap that a link needs."""
    apart = F.lit(0)
    for i in range(BINS // 64):
        apart = apart + F.bit_count(F.get(odd1, F.lit(i)).bitwiseXOR(F.get(odd2, F.lit(i))))
    return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & ((den - num) * (F.col(n1) + F.col(n2)) >= (den + num) * apart)


def _coarse(odd: str) -> list[Column]:
    """The parities of COARSE * 64 wider ranges, as columns q0 ...: what postings carry along."""
    words = BINS // 64
    out = []
    for i in range(COARSE):
        q = F.get(odd, F.lit(i))
        for j in range(i + COARSE, words, COARSE):
            q = q.bitwiseXOR(F.get(odd, F.lit(j)))
        out.append(q.alias(f"q{i}"))
    return out


def _suffix_bound(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    p = pairs.join(info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    p = p.join(info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    return p.where(_fits("na", "nb", "oa", "ob", num, den)).select("a", "b").distinct()


def _merged(lists: DataFrame) -> DataFrame:
    """The lists of one smallest member as one, where that makes fewer pairs than they do one by one.

    Members of a merged list need not share a shingle, so its m and pos let every pair pass the positional filter.
    """
    heads = lists.groupBy("list").agg(F.min("id").alias("a"), F.count("*").cast("double").alias("c"))
    rows = lists.join(heads.select("list", "a"), "list")
    apart = heads.groupBy("a").agg(F.sum(F.col("c") * F.col("c")).alias("apart"))
    union = rows.select("a", "id").distinct().groupBy("a").agg(F.count("*").cast("double").alias("u"))
    whole = apart.join(union, "a").where("u * u < apart").select("a", F.lit(True).alias("whole"))
    rows = lists.join(heads.join(whole, "a", "left").select("list", "a", "whole"), "list").withColumn("list", F.when(F.col("whole"), F.xxhash64("a", F.lit("merged"))).otherwise(F.col("list")))
    rows = rows.groupBy("list", "id", "n").agg(F.sum("m").alias("m"), F.max("pos").alias("pos"), F.any_value("whole").alias("whole"))
    return rows.select("list", "id", "n", F.when(F.col("whole"), F.col("n")).otherwise(F.col("m")).alias("m"), F.when(F.col("whole"), 0).otherwise(F.col("pos")).alias("pos"))


def row_key(id_col: Column, text: Column) -> Column:
    """The id as a long; for a null id a number above all ids that the text decides."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(text.cast("string")).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED)))


class _Join:
    """The steps that components and links share: info (id, n, f1, f2, odd by row), classes (f1, f2, rep), reps (id, n, odd), live postings."""

    def __init__(self, docs: DataFrame, folder: str, k: int, num: int, den: int, id_col: str, text_col: str):
        self.folder, self.k, self.num, self.den = folder, k, num, den
        self.docs = docs = docs.select(row_key(docs[id_col], docs[text_col]).alias("id"), docs[text_col].cast("string").alias("text"))
        self.info = common.table(_summaries(docs, k), folder, "info")
        self.classes = common.table(self.info.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), folder, "classes")
        reps = self.info.join(self.classes, ["f1", "f2"]).where("id = rep").select("id", "n", "odd").dropDuplicates(["id", "n", "odd"])
        self.reps = common.table(reps, folder, "reps")
        self.frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, folder, k, num, den))  # 2**MOST_BITS bits at most
        post, of_token = _postings(docs, self.frequent, k, num, den), Window.partitionBy("token")
        sums = {f"s{i}": F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 33)).over(of_token) for i in range(3)}
        rare = post.where("not often").repartition("token").withColumns({"low": F.min("id").over(of_token), "high": F.max("id").over(of_token), "s": F.count("*").over(of_token), **sums}).where("low < high")
        some = rare.select(F.xxhash64("s", *sums).alias("list"), "id", "n", "pos").unionAll(post.where("often").select(F.col("token").alias("list"), "id", "n", "pos"))
        some = some.join(self.reps.select("id").distinct(), "id", "left_semi")
        lists = common.table(some.groupBy("list", "id", "n").agg(F.count("*").alias("m"), F.max("pos").alias("pos")), folder, "lists")
        self.live = common.table(_merged(lists), folder, "live")

    def fits(self) -> Column:
        """Length, parity and positional filters on a pair of postings x, y."""
        num, den, apart = self.num, self.den, F.lit(0)
        for i in range(COARSE):
            apart = apart + F.bit_count(F.col(f"q{i}x").bitwiseXOR(F.col(f"q{i}y")))
        room = F.least("px", "py") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
        size = F.col("nx") + F.col("ny")
        return (den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")) & ((den - num) * size >= (den + num) * apart) & ((den + num) * room >= num * size)

    def side(self, s: str, rows: DataFrame) -> DataFrame:
        return rows.select("list", F.col("m").alias("m" + s), F.col("comp").alias("c" + s), F.col("id").alias("i" + s), F.col("n").alias("n" + s), F.col("pos").alias("p" + s), *[F.col(f"q{i}").alias(f"q{i}{s}") for i in range(COARSE)])

    def pairs(self, met: DataFrame) -> DataFrame:
        """(a, b), once each, of the pairs of postings that leave room for a link by the shingles their prefixes share."""
        met = met.groupBy("ix", "iy", "nx", "ny").agg(F.sum("mx").alias("o"), F.max("px").alias("px"), F.max("py").alias("py"))
        met = met.where((self.den + self.num) * (F.col("o") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1) >= self.num * (F.col("nx") + F.col("ny")))
        return met.select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b")).distinct()

    def links(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The pairs that pass the suffix filter, and those of them that link."""
        pairs = common.table(_suffix_bound(pairs, self.reps, self.num, self.den), self.folder, f"pairs-{name}")
        return pairs, _verified(pairs, _named_sets(self.docs, pairs, self.folder, f"sets-{name}", self.k), self.num, self.den)

    def marked(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.reps.select("id", "n", *_coarse("odd")), ["id", "n"])


def jaccard_components(
    docs: DataFrame, folder: str, k: int = K, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", keys: bool = False
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links, its own included).

    Null or empty texts and texts without words have no shingles and link with nothing. Shorter texts than k words have one
    shingle of all their words. A row of a null id links like others and is known by its text (row_key); its class takes the smallest id that is not null, null if
    there is none. Repeated rows are copies. Rows that share an id but not a text are classes of their own, joined only
    where both have that id as their smallest. Ids are below UNNAMED. Other columns play no part. An empty table gives an empty result.
    keys: row_key and component_key, too, the same with numbers for null ids.
    """
    j = _Join(docs, folder, k, num, den, id_col, text_col)
    live = j.live
    first = live.join(live.groupBy("list").agg(F.min("id").alias("a")), "list").where("a < id").select("a", F.col("id").alias("b")).distinct()
    first, links = j.links(first, "1")
    links = common.table(links, folder, "links-1")
    comp = common.components(links, folder, "cc1")

    named = live.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    members = named.groupBy("list", "comp").agg(F.count("*").alias("k"))
    mixed = members.groupBy("list").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("c")).where("c > 1").select("list", "main")
    open_ = common.table(j.marked(named.join(mixed, "list")), folder, "open")
    rest = j.side("x", open_.where("comp <> main"))
    met = rest.join(j.side("y", open_.where("comp = main")), "list").where(j.fits())
    met = met.unionByName(rest.join(j.side("y", open_.where("comp <> main")), "list").where(F.col("cx") < F.col("cy")).where(j.fits()))
    _, more = j.links(j.pairs(met).join(first, ["a", "b"], "left_anti"), "2")
    comp = common.components(common.table(links.unionAll(more), folder, "links-2"), folder, "cc2")
    common.drop(docs.sparkSession, folder, "frequent", "lists", "live", "open", "reps", *(f"{t}-{i}" for t in ("pairs", "sets", "links") for i in (1, 2)))

    out = j.info.select("id", "n", "f1", "f2").join(j.classes, ["f1", "f2"], "left")
    out = out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.withColumn("component", F.coalesce("component", "rep"))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    out = out.select(named("id").alias(id_col), F.col("n").alias("n_shingles"), named("component").alias("component_id"), F.col("id").alias("row_key"), F.col("component").alias("component_key"))
    return out if keys else out.drop("row_key", "component_key")


def jaccard_links(docs: DataFrame, folder: str, k: int = K, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) of the classes' smallest ids with a < b, and (id_col, class_id) for each row, null without shingles.

    As many rows as there are links between different sets: a group of n near copies has up to n * (n - 1) / 2. Nulls, ties and
    empty tables as in jaccard_components.
    """
    j = _Join(docs, folder, k, num, den, id_col, text_col)
    live = j.marked(j.live.withColumn("comp", F.lit(0)))
    _, links = j.links(j.pairs(j.side("x", live).join(j.side("y", live), "list").where("ix < iy").where(j.fits())), "all")
    classes = j.info.select("id", "n", "f1", "f2").join(j.classes, ["f1", "f2"], "left")
    return common.table(links, folder, "links"), classes.select(F.when(F.col("id") < UNNAMED, F.col("id")).alias(id_col), F.when(F.col("n") > 0, F.col("rep")).alias("class_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"), common.scratch(spark))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
f AS (SELECT g, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""",
}
