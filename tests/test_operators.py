"""Operators on small hand-made frames: the edge rows of each."""

from pyspark.sql import functions as F

from quarry.operators import browse, changes, checks, lookups, ordered, paging, regions


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def catalog(spark):
    return spark.createDataFrame(
        [("r", None, "folder", "Top", None), ("a", "r", "folder", "Alpha", None), ("b", "a", "file", "Read Me", "TEXT"), ("c", "a", "file", "100%_x", "PICT"), ("d", "r", "file", "read me", "TEXT")],
        "id string, parent string, kind string, name string, type string",
    )


def test_children_of_folder_and_of_file(spark):
    assert rows(browse.children(catalog(spark), "a"), "id") == [("b",), ("c",)]
    assert rows(browse.children(catalog(spark), "d"), "id") == [("d",)]
    assert rows(browse.children(catalog(spark), "x"), "id") == []


def test_paths_and_ancestors(spark):
    assert ("b", "Top:Alpha:Read Me", 2) in rows(browse.paths(catalog(spark), 4))
    loop = spark.createDataFrame([("x", "y", "folder", "X"), ("y", "x", "folder", "Y")], "id string, parent string, kind string, name string")
    assert browse.ancestors(loop, 8).count() >= 2  # a loop ends


def test_names_and_globs(spark):
    e = catalog(spark)
    assert rows(e.where(browse.name_matches(F.col("name"), "READ ME")), "id") == [("b",), ("d",)]
    assert rows(e.where(browse.name_matches(F.col("name"), "100%_?")), "id") == [("c",)]
    assert rows(e.where(browse.name_matches(F.col("name"), "*%*")), "id") == [("c",)]
    assert rows(browse.find(e, type_="TEXT", name="r*"), "id") == [("b",), ("d",)]


def test_contains_is_byte_aligned(spark):
    d = spark.createDataFrame([(bytearray(b"\x12\x34\x56"),), (bytearray(b"\x23\x45"),), (None,)], "b binary")
    assert d.where(browse.contains_bytes(F.col("b"), b"\x23\x45")).count() == 1
    assert d.where(browse.contains_bytes(F.col("b"), b"")).count() == 2


def test_tree_filter_and_page(spark):
    assert rows(browse.tree_filter(catalog(spark), F.col("name") == "Read Me", 4), "id") == [("a",), ("b",), ("r",)]
    d = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "k string, i int")
    assert rows(browse.page(d, ["k", "i"], 2, ("x", 3))) == [("x", 4), ("y", 9)]
    assert {r[-1] for r in rows(paging.limited(d, ["k", "i"], 6))} == {False} and {r[-1] for r in rows(paging.limited(d, ["k", "i"], 5))} == {True}


def test_lookups(spark):
    t = spark.createDataFrame([("T", "a", "exact"), ("T", None, "any")], "k string, s string, v string")
    r = spark.createDataFrame([(1, "T", "a"), (2, "T", "z"), (3, "U", "a")], "i int, k string, s string")
    assert rows(lookups.fallback(r, t, "k", "s", "v"), "i", "v") == [(1, "exact"), (2, "any"), (3, None)]
    runs = spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "k int, s int, v string")
    points = spark.createDataFrame([(1, 5), (1, 10), (1, 19), (1, 25), (2, 1)], "k int, t int")
    assert rows(lookups.as_of(points, runs, "k", "t", "s", ["v"]), "k", "t", "v") == [(1, 10, "x"), (1, 19, "x"), (1, 25, "y"), (1, 5, "x"), (2, 1, None)]
    a, b = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, v int"), spark.createDataFrame([(1, None), (2, 6), (4, 1)], "k int, v int")
    assert rows(lookups.snapshot_diff(a, b, "k", ["v"])) == [(2, "changed"), (3, "removed"), (4, "added")]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "s int, t int")
    assert rows(lookups.follow(e, "s", "t", 5)) == [(1, 3, 2, True), (2, 1, 2, True), (3, 2, 2, True), (7, 8, 1, False)]
    x = spark.createDataFrame([(0, 3), (130, 2), (5, 0)], "s long, n long")
    p = spark.createDataFrame([(i,) for i in (0, 2, 3, 131, 132)], "b long")
    assert rows(lookups.range_join(p, x, "b", "s", "n", 64), "b", "s") == [(0, 0), (131, 130), (2, 0)]
    s = spark.createDataFrame([("a.tar.gz",), ("A.GZ",), ("none",), (None,)], "n string")
    assert dict(rows(lookups.longest_suffix(s.na.drop(), "n", [".gz", ".tar.gz"]))) == {"a.tar.gz": ".tar.gz", "A.GZ": ".gz", "none": None}


def test_checks(spark):
    x = spark.createDataFrame([(1, 0, 4), (1, 4, 2), (2, 0, 1), (2, 5, 1)], "o int, s long, n long")
    assert rows(checks.fragmentation(x, "o", "s", "n")) == [(2, 1, 2, 8)]
    v = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "z"), (3, "z"), (3, "a")], "k int, v string")
    assert rows(checks.mode_smallest(v, "k", "v")) == [(1, "a", 1), (3, "z", 2)]
    f = spark.createDataFrame([("one", "flag"), ("two", "fatal"), ("three", "flag")], "stage string, severity string")
    assert rows(checks.run_stages(f, ["one", "two", "three"]), "stage") == [("one",), ("two",)]


def test_ordered(spark):
    d = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 7, 65535, 65536, 65537)], "b long")
    assert rows(ordered.islands(d, "b")) == [(1, 3), (65535, 3), (7, 1)]
    assert rows(ordered.islands(d.where("b < 0"), "b")) == []
    n = spark.createDataFrame([("a.txt", 1), ("A.TXT", 2), ("b", 3), ("B", 4)], "n string, o int")
    assert [r[0] for r in rows(ordered.unique_names(n, "n", ["o"]), "unique_name")] == ["A ~2.TXT", "B ~2", "a.txt", "b"]
    for used, want in (([128, 129, 131], 130), ([], 128)):
        u = spark.createDataFrame([(i,) for i in used], "i long")
        assert ordered.next_free(u, "i", 128, 199).first()[0] == want
    full = spark.createDataFrame([(i,) for i in [*range(128, 200), 127]], "i long")
    assert ordered.next_free(full, "i", 128, 199).first()[0] == 126


def test_regions(spark):
    a, b = spark.createDataFrame([("k", 0, 4), ("k", 2, 6), ("k", 9, 9)], "k string, low long, high long"), spark.createDataFrame([("k", 4, 8)], "k string, low long, high long")
    assert rows(regions.combine(a, b, "k", "union")) == [("k", 0, 8)]
    assert rows(regions.combine(a, b, "k", "intersect")) == [("k", 4, 6)]
    assert rows(regions.combine(a, b, "k", "difference")) == [("k", 0, 4)]
    assert rows(regions.combine(a, b, "k", "xor")) == [("k", 0, 4), ("k", 6, 8)]


def test_changes(spark):
    e = catalog(spark)
    assert rows(changes.remove(e, "a", 4), "id") == [("d",), ("r",)]
    assert ("a", "r") in rows(changes.move(e, "a", "b", 4), "id", "parent")  # not below itself
    assert ("b", "r") in rows(changes.move(e, "b", "r", 4), "id", "parent")
    log = spark.createDataFrame([("x", 1, "put", "1"), ("x", 2, "rm", None), ("y", 3, "put", "2")], "k string, v int, op string, val string")
    assert rows(changes.at_position(log, 1, "k", "v", "op", ["val"], "rm")) == [("x", "1")]
    assert rows(changes.at_position(log, 3, "k", "v", "op", ["val"], "rm")) == [("y", "2")]
