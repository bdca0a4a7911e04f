"""Catalog browsing: children, facts, paths, find, tree filter, pages.

Entries are rows (id, parent, kind, name, ...): id and parent strings, parent null at the top, kind one of 'folder', 'file',
'container'. Trees are walked by pointer doubling: log2(depth) joins, each of one row per node and known ancestor.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.links import hfs_fold
from quarry.scratch import stored

#: Levels of nesting a walk follows at most; deeper nodes, and loops, have no path (the checks report them).
MAX_DEPTH = 100


def children(entries: DataFrame, parent: str) -> DataFrame:
    """The children of an entry; an entry without children that is no folder lists itself."""
    below = entries.where(F.col("parent") == parent)
    own = entries.where((F.col("id") == parent) & (F.col("kind") == "file"))
    return below.unionByName(own)


def flag_names(flags: Column, names: Mapping[int, str]) -> Column:
    """The names of the bits that are set, in the order of names."""
    table = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(name).alias("name")) for bit, name in names.items()])
    return F.transform(F.filter(table, lambda x: flags.bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def ancestors(entries: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, distance) for every entry, itself (distance 0) and each entry above it, up to depth levels.

    Up to four levels the two doublings are one plan; deeper, each doubling is a stored table, and the walk ends with the first that finds nothing new.
    """
    known, reach = entries.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), 1
    while reach < depth:
        if depth > 4:
            known = stored(known)
        far = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.id"))
        far = far.select("a.id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance")).where(f"distance > {reach} and distance <= {min(2 * reach, depth)}").distinct()
        if depth > 4:
            far = stored(far)
            if far.isEmpty():
                break
        known, reach = known.unionByName(far), 2 * reach
    return known.unionByName(entries.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))


def paths(entries: DataFrame, depth: int, separator: str = ":") -> DataFrame:
    """(id, path, depth): names from the top down."""
    up = ancestors(entries, depth).join(entries.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    names = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "name"))))
    return up.groupBy("id").agg(F.array_join(F.transform(names, lambda x: x["name"]), separator).alias("path"), F.max("distance").cast("long").alias("depth"))


def glob_regex(pattern: str) -> str:
    """A name pattern with * and ? as a regular expression; all else is literal, case does not count, * crosses line ends."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def name_matches(name: Column, pattern: str) -> Column:
    """Name equality as an HFS catalog has it, or a glob without regard to case where the pattern has wildcards."""
    if not set(pattern) & set("*?"):
        return hfs_fold(name) == hfs_fold(F.lit(pattern))
    return name.rlike(glob_regex(pattern))


def find(entries: DataFrame, kind: str | None = None, name: str | None = None, type_: str | None = None, max_depth: int | None = None, creator: str | None = None) -> DataFrame:
    """Conjunction of criteria, the cheap ones first; folders fail any criterion on files. creator needs a column of that name."""
    out = entries
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if type_ is not None:
        out = out.where((F.col("kind") != "folder") & (F.col("type") == type_))
    if creator is not None:
        out = out.where((F.col("kind") != "folder") & (F.col("creator") == creator))
    if name is not None:
        out = out.where(name_matches(F.col("name"), name))
    return out


def container_depth(entries: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """entries with depth: how many containers stand above each; folders cost no depth."""
    kinds = entries.where("kind = 'container'").select(F.col("id").alias("ancestor"))
    above = ancestors(entries, depth).where("distance > 0").join(kinds, "ancestor").groupBy("id").agg(F.count("*").cast("int").alias("depth"))
    return entries.drop("depth").join(above, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def contains_bytes(data: Column, needle: bytes, limit: int = 64 << 20) -> Column:
    """Whether the bytes hold the needle; data of over limit bytes are skipped, an empty needle matches."""
    return (F.octet_length(data) <= limit) & F.contains(data, F.unhex(F.lit(needle.hex())))


def tree_filter(entries: DataFrame, matches: Column, depth: int = MAX_DEPTH) -> DataFrame:
    """Entries that match, that stand above a match or below one."""
    up = ancestors(entries, depth)
    hits = entries.where(matches).select("id")
    above = up.join(hits, "id", "left_semi").select(F.col("ancestor").alias("id"))
    below = up.join(hits.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id")
    return entries.join(above.unionByName(below).distinct(), "id", "left_semi")


def page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """One page in order of keys (a unique key last): the rows after a cursor, found by comparison, not by counting."""
    if after is not None:
        past = F.lit(False)
        for i in reversed(range(len(keys))):
            past = (F.col(keys[i]) > F.lit(after[i])) | ((F.col(keys[i]) == F.lit(after[i])) & past)
        df = df.where(past)
    return df.orderBy(*keys).limit(size)
