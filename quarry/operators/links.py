"""Joins and aggregations over catalogs and resources: links, pairs, attributes, first-seen orders, subtree totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_links(links: DataFrame, inodes: DataFrame, ref: str, key: str) -> DataFrame:
    """Each row of links with target (its inode's key, null where the inode is missing)."""
    return links.join(inodes.select(F.col(key).alias("target")), F.col(ref) == F.col("target"), "left")


def link_counts(links: DataFrame, inodes: DataFrame, ref: str, key: str, stored: str) -> DataFrame:
    """(key, stored, found) of the inodes whose stored number of links is another than that of the links to them."""
    found = links.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("found"))
    out = inodes.select(key, F.col(stored).cast("long").alias("stored")).join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.where("stored <> found")


def aliases_to(entries: DataFrame, aliases: DataFrame, key: str, target: str, name: Column) -> DataFrame:
    """(key, n, names) of the entries that aliases name, the names sorted."""
    found = aliases.groupBy(F.col(target).alias(key)).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names"))
    return entries.select(key).join(found, key)


def apple_double_pairs(files: DataFrame, folder: str, name: str) -> DataFrame:
    """(folder, name, has_data, has_sidecar): a file "._x" belongs to "x" of its folder; either may be alone."""
    side = F.col(name).startswith("._")
    named = files.select(F.col(folder).alias("folder"), F.when(side, F.substring(name, 3, 1 << 20)).otherwise(F.col(name)).alias("name"), side.alias("side"))
    return named.groupBy("folder", "name").agg(F.max(~F.col("side")).alias("has_data"), F.max("side").alias("has_sidecar"))


def same_id(resources: DataFrame, fork: str, kind: str, id_: str, left: str, right: str) -> DataFrame:
    """(fork, id, has_right) of every resource of the left kind: whether one of the right kind has its ID (a text's styles, an icon's mask)."""
    a = resources.where(F.col(kind) == left).select(F.col(fork).alias("fork"), F.col(id_).alias("id")).distinct()
    b = resources.where(F.col(kind) == right).select(F.col(fork).alias("fork"), F.col(id_).alias("id"), F.lit(True).alias("has_right")).distinct()
    return a.join(b, ["fork", "id"], "left").withColumn("has_right", F.coalesce("has_right", F.lit(False)))


def local_ids(references: DataFrame, mapping: DataFrame, keys: Sequence[str], local: str, resource: str) -> DataFrame:
    """References with the resource that the bundle's mapping gives their local ID; null where it has none."""
    return references.join(mapping.select(*keys, local, resource), [*keys, local], "left")


def without_icon(folders: DataFrame, files: DataFrame, key: str, parent: str, is_icon: Column) -> DataFrame:
    """The flagged folders that have no icon file."""
    return folders.join(files.where(is_icon).select(F.col(parent).alias(key)), key, "left_anti")


def by_key(entries: DataFrame, wanted: DataFrame, parent: str, name: str) -> DataFrame:
    """The entries under the composite catalog keys (parent, name) of wanted."""
    return entries.join(wanted.select(parent, name).distinct(), [parent, name], "left_semi")


def out_of_order(rows: DataFrame, group: str, ordinal: str, value: str) -> DataFrame:
    """Rows whose value is smaller than that before it in its group (equal ordinals by value), with that as before."""
    w = Window.partitionBy(group).orderBy(ordinal, value)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def adjacent(words: DataFrame, group: str, offset: str, step: int, value: str) -> DataFrame:
    """Pairs (group, offset, first, second) of the values at an offset and at step bytes behind it."""
    then = words.select(F.col(group), (F.col(offset) - step).alias(offset), F.col(value).alias("second"))
    return words.select(group, offset, F.col(value).alias("first")).join(then, [group, offset])


def kinds_first_seen(resources: DataFrame, fork: str, kind: str, ordinal: str) -> DataFrame:
    """(fork, kinds): each fork's distinct kinds in the order of their first resources."""
    first = resources.groupBy(fork, kind).agg(F.min(ordinal).alias("first"))
    order = F.array_sort(F.collect_list(F.struct("first", kind)))
    return first.groupBy(fork).agg(F.transform(order, lambda x: x[kind]).alias("kinds"))


def listed(resources: DataFrame, fork: str, kind: str, id_: str, ordinal: str) -> DataFrame:
    """resources with kind_rank (by first-seen order in their fork) and place (by ID inside the kind)."""
    first = resources.groupBy(fork, kind).agg(F.min(ordinal).alias("_first"))
    ranked = first.withColumn("kind_rank", F.row_number().over(Window.partitionBy(fork).orderBy("_first", kind)))
    place = F.row_number().over(Window.partitionBy(fork, kind).orderBy(id_, ordinal))
    return resources.join(ranked.drop("_first"), [fork, kind]).withColumn("place", place)


def distinct_first_seen(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """(value, ordinal) of each distinct value where it first stands."""
    return rows.groupBy(value).agg(F.min(ordinal).alias(ordinal))


def subtree_totals(entries: DataFrame, up: DataFrame) -> DataFrame:
    """(id, files, total) of every folder, over all levels below it; up: ancestors of entries."""
    files = entries.where("kind = 'file'").select("id", "size").join(up, "id")
    sums = files.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("files"), F.sum("size").alias("total"))
    return entries.where("kind = 'folder'").select("id").join(sums, "id", "left").select("id", F.coalesce("files", F.lit(0)).alias("files"), "total")


def sibling_keys(entries: DataFrame, up: DataFrame, digits: int = 8) -> DataFrame:
    """(id, key): keys sort entries depth first, siblings by name; a parent's key begins those of all below it."""
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("name", "id"))
    ranked = entries.select(F.col("id").alias("ancestor"), F.lpad(rank.cast("string"), digits, "0").alias("place"))
    steps = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "place"))))
    return up.join(ranked, "ancestor").groupBy("id").agg(F.array_join(F.transform(steps, lambda x: x["place"]), "/").alias("key"))


def edit(entries: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], flags: str) -> DataFrame:
    """New values of columns where changes has one, and flags with change columns set_bits and clear_bits applied (lock, unlock, bless)."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], "set_bits", "clear_bits")
    rows = entries.join(new, key, "left")
    bits = F.col(flags).bitwiseOR(F.coalesce("set_bits", F.lit(0))).bitwiseAND(F.bitwise_not(F.coalesce("clear_bits", F.lit(0))))
    return rows.withColumns({**{c: F.coalesce(f"new_{c}", c) for c in columns}, flags: bits}).select(*entries.columns)


def capped(entries: DataFrame, order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first most entries, and a diagnostic row if there are more: what reading a volume stops at."""
    first = entries.orderBy(*order).limit(most)
    note = entries.limit(most + 1).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit("error").alias("severity"), F.lit(f"more than {most} entries; reading stopped").alias("message"))
    return first, note


def totals(files: DataFrame, status: str, size: str) -> DataFrame:
    """(status, files, bytes) by status, and of all under the status "all"."""
    out = files.rollup(status).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.grouping(status).alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(status)).alias("status"), "files", "bytes")


def splice(data: Column, at: int, count: int, new: Column) -> Column:
    """The bytes (or characters) with count of them from at (0 the first) replaced."""
    return F.concat(F.substring(data, 1, at), new, F.substring(data, at + count + 1, 1 << 30))


def occurrence(text: Column, needle: str, ordinal: int) -> Column:
    """The place (from 0) of an occurrence of the needle, counted without overlap; null if there are fewer."""
    before = F.length(F.call_function("substring_index", text, F.lit(needle), F.lit(ordinal)))
    return F.when(before < F.length(text), before).cast("long")


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle stands in the text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


#: Small letters that equal their capitals in HFS names; other marked letters are letters of their own.
HFS_SMALL = "abcdefghijklmnopqrstuvwxyzäåàãæçéñöõøœü"
HFS_LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÅÀÃÆÇÉÑÖÕØŒÜ"


def hfs_fold(name: Column) -> Column:
    """Names that an HFS catalog takes for one fold to one; a non-breaking space is a space."""
    return F.translate(name, HFS_SMALL + " ", HFS_LARGE + " ")


def dos_time(date: Column, time: Column) -> Column:
    """The timestamp of a FAT date and time; null where the date has no such day."""
    part = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(F.lit(mask))
    day = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(date, 9, 127) + 1980, part(date, 5, 15), part(date, 0, 31), part(time, 11, 31), part(time, 5, 63), part(time, 0, 31) * 2)
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd HH:mm:ss"))


def rgb555(c: Column) -> Column:
    """A 16-bit colour as #RRGGBB, five bits widened to eight by repeating the top ones."""
    wide = lambda shift: (v := F.shiftright(c, shift).bitwiseAND(F.lit(31))).bitwiseOR(F.lit(0)) * 8 + F.shiftright(v, 2)
    return F.format_string("#%02X%02X%02X", wide(10), wide(5), wide(0))


def resolve_paths(paths: DataFrame, known: DataFrame, fold=hfs_fold) -> DataFrame:
    """Each row of paths (path) with the id of the entry there, null if none; known: (id, path). Names match as the catalog's do."""
    table = known.select(fold(F.col("path")).alias("folded"), F.col("id"))
    return paths.withColumn("folded", fold(F.col("path"))).join(table, "folded", "left").drop("folded")


def result_json(entries: DataFrame, fields: Mapping[str, Column]) -> Column:
    """One JSON object of the given fields, null ones left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
