"""The pipeline's stages against plain Python versions of them, which call none of the operators."""

import hashlib
import itertools
import math
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.llm import bpe, common, jaccard_join, quality, substring_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, row string, _kept string, _s int"
PASSAGE = " ".join(f"p{i}" for i in range(50))
LONG = " ".join(f"v{i % 700}x{i % 31}" for i in range(4000))


def words(text):
    return (text or "").encode().split()


def near_copies(rows):
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r["text"])]
        sets[r["doc_id"], r["text"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    order = lambda k: (k[0] is None, k[0] or 0, k[1] or "")
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=order)
            root[y] = x
    return sorted({k for k in sets if find(k) == k}, key=order)


def repeats(rows):
    seen = {}
    for k, r in enumerate(rows):
        w = words(r["text"])
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + 35))
    return [r | ({"text": (t := b" ".join(x for i, x in enumerate(words(r["text"])) if i not in g).decode()), "n_chars": len(t)} if g else {}) for r, g in zip(rows, gone, strict=True)]


def mix(rows):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, left, total = {}, dict(sizes), 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        for s in over:
            target[s] = 2 * left.pop(s)
    out = []
    for s in order:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (len(words(r["text"])), r["doc_id"] is not None, r["doc_id"]))
        u = int(hashlib.md5(("mix:" + (s or "")).encode()).hexdigest()[:12], 16) / 2**48
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        for i, r in enumerate(mine):
            out += [r] * (math.floor((i + 1) * rate + u) - math.floor(i * rate + u))
    return out


def encode(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        out.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def dicts(df):
    return [r.asDict() for r in df.collect()]


def keyed(rows):
    return sorted(map(repr, rows))


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    folder = common.scratch(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mixing", "bpe"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(common.table(stage(spark, kept[-1], SF), folder, name))
        assert kept[-1].columns == docs.columns
    rows = [dicts(d) for d in kept]
    assert 0 < len(rows[1]) <= len(rows[0]) and keyed(rows[1]) == keyed([r for r in rows[0] if r["doc_id"] in {x["doc_id"] for x in rows[1]}])
    assert keyed((r["doc_id"], r["text"]) for r in rows[2]) == keyed(near_copies(rows[1]))
    assert keyed(rows[3]) == keyed(repeats(rows[2]))
    assert keyed(rows[4]) == keyed(mix(rows[3]))
    final = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert keyed(tuple(r) for r in final.collect()) == keyed(encode(rows[4]))
    assert keyed(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == keyed(encode(rows[4]))


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = ["a b c", "a b c", None, "", " \t", base, base + " end", base, PASSAGE + " x", "y " + PASSAGE + " z", LONG, LONG.replace("v5x5", "changed", 1), "it's Ωμέγα 日本 😀"]
    rows = [(i, t, "en", [None, "", "b"][i % 3], len(t or ""), "t", "r", "k", i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base + " other end", None, None, None, None, None, None, None), (None, "a null id alone", "en", "b", 3, "", "", "", 1), (None, "a null id alone", "en", "b", 3, "", "", "", 1), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("_predicted", F.lit("clash")).withColumn("n_words", F.lit(1)).repartition(3)


def test_stages_on_odd_rows(spark, odd):
    rows = dicts(odd)
    filtered = corpus_pipeline.filter_quality(spark, odd, SF)
    assert filtered.columns == odd.columns and set(keyed(dicts(filtered))) <= set(keyed(rows))
    left = corpus_pipeline.drop_near_copies(spark, odd, SF)
    assert left.columns == odd.columns
    assert keyed((r["doc_id"], r["text"]) for r in dicts(left)) == keyed(near_copies(rows))
    cut = corpus_pipeline.cut_repeats(spark, odd, SF)
    assert cut.columns == odd.columns and keyed(dicts(cut)) == keyed(repeats(rows))
    mixed = corpus_pipeline.mix(spark, odd, SF)
    assert mixed.columns == odd.columns
    assert keyed((r["doc_id"], r["text"]) for r in dicts(mixed)) == keyed((r["doc_id"], r["text"]) for r in mix(rows))
    assert keyed(tuple(r) for r in corpus_pipeline.encode(spark, odd, SF).collect()) == keyed(encode(rows))


def test_stages_on_no_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).collect() == []


class Sent(Exception):
    """What mapInArrow was given."""


class Docs:
    """Stands for a DataFrame up to its mapInArrow."""

    def __getitem__(self, name):
        return F.lit("")

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):  # noqa: N802
        raise Sent(function)


def sent(step, *args):
    with pytest.raises(Sent) as e:
        step(Docs(), *args)
    return e.value.args[0]


def test_workers_take_little_beside_the_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(400)) for _ in range(1000)]  # a whole Arrow batch of 2 MB
    vocabulary = np.unique(quality.Pieces([t.encode() for t in texts]).hashes())[:1000]
    vectors, coder = np.ones((len(vocabulary), quality.DIM), np.float32), bpe.Encoder(bpe.default_path())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    summaries, paths, count = sent(jaccard_join._summaries, 5), sent(substring_dedup._paths, 35, 8), sent(bpe.frequent_words, "", bpe.default_path())
    steps = {
        "contexts": lambda: quality.contexts([t.encode() for t in texts], vocabulary),
        "features": lambda: quality.features([t.encode() for t in texts], vocabulary, vectors),
        "summaries": lambda: [0 for _ in summaries([batch])],
        "paths": lambda: [0 for _ in paths([batch])],
        "count": lambda: [0 for _ in count([batch.select(["text"])])],
        "encode": lambda: [0 for _ in coder.encode(texts)],
    }
    bpe._classes()
    most = {}
    for name, step in steps.items():
        tracemalloc.start()
        step()
        most[name] = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
    assert max(most.values()) < 40, most


def test_no_vocabulary_travels_with_the_count_of_words(spark):
    assert len(cloudpickle.dumps(sent(bpe.frequent_words, "", bpe.default_path()))) < 1 << 17
