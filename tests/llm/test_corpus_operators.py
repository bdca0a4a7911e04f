"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, embedding_dedup, gru, jaccard_join, lexicon, licenses, mixing, quality, substring_dedup, textkit, token_counts, topk_search, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return (text or "").encode().split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.choice([1, 3, 4, 5, 40, 90]))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies, a shared passage, a repeat inside one text
        t = texts[i].split()
        if len(t) > 30:
            t[rng.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
    passage = " ".join(rng.choices(VOCABULARY, k=50))
    texts += [texts[3], texts[3], passage + " x", "y\n" + passage, passage + " z " + passage, None, "", " \t\n", "one", "one", "a b c d", "A B C D", "a " * 400, "long " + " ".join(rng.choices(VOCABULARY, k=5000)), "é ß ÿ ñ " * 12]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "Z"][i % 4], len(t or "")) for i, t in enumerate(corpus())]
    rows += [rows[3], (None, "a null id " * 9, None, None, None), (None, None, None, "a", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumn("n_tokens", F.lit("clash")).withColumn("_extra", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, k=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_word_hashes_agree_with_split():
    for t in corpus():
        t = (t or "").encode()
        w = textkit.Words([t, b"x", t])
        assert [w.buf[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == [*t.split(), b"x", *t.split()]
        h = w.hashes()
        assert (h[: w.counts[0]] == h[w.counts[0] + 1 :]).all()


def test_jaccard_components(spark, docs, empty):
    got = jaccard_join.jaccard_components(docs, common.scratch(spark)).collect()
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.jaccard_components(empty, common.scratch(spark)).collect() == []


def test_remove_repeats(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + 35))
    want = sorted((str(d), len(words(t)), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(words(t)) if i not in g)).hexdigest()) for (d, t), g in zip(rows, gone, strict=True))
    out = substring_dedup.remove_repeats(docs, common.scratch(spark))
    assert sorted((str(r.doc_id), r._n_words, r._n_removed, r._kept_sha256) for r in out.collect()) == want
    assert sum(w[2] for w in want) > 100 and "n_tokens" in out.columns
    assert substring_dedup.remove_repeats(empty, common.scratch(spark)).collect() == []


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs, common.scratch(spark)).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, left, total = {}, dict(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * left.pop(s)
    target |= {s: weight[s] * level for s in left}
    assert len(out) == docs.count()
    for s in order:
        mine = [r for r in out if r.source == s]
        assert all(r._source_size == sizes[s] and math.isclose(r._target, target[s]) and 0 <= r._copies <= 2 for r in mine)
        assert abs(sum(r._copies * r._size for r in mine) - target[s]) <= 2 * max(r._size for r in mine)
    again = mixing.mix_sources(docs.repartition(5), common.scratch(spark)).collect()
    assert sorted((str(r.doc_id), r._size, r._copies) for r in out) == sorted((str(r.doc_id), r._size, r._copies) for r in again)
    assert mixing.emit(docs, common.scratch(spark)).count() == sum(r._copies for r in out)
    assert mixing.mix_sources(empty, common.scratch(spark)).collect() == []


def test_token_counts(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()) == want
    odd = [" a", "a ", "  a  b   ", " ", "▁", "a ▁b", "a▁ b", "x\n\ny", "ab " * 20000, " " * 40000, "a" * 40000 + " b", "foo bar  baz ▁ " * 5000, "<s> </s>\x00"]
    assert token_counts.counts([t.encode() for t in odd], token_counts.default_model()).tolist() == [len(sp.encode(t)) for t in odd]
    assert token_counts.count_tokens(empty).collect() == []


def public_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    return library


def test_bpe_without_the_library(monkeypatch):
    """Apostrophes, Greek, CJK, emoji, long words, added tokens: the same ids, and the library is never called."""
    rng = random.Random(11)
    pool = [*"''sstmdrevell SRVE.-_ 12\n\té", "İ", "Σ", "ß", "日", "本", "😀", "क", "\u0301", "\u200d", "<|endoftext|>", "<|start", " the ", "don't", "ǅ", "한", "각", "\x85", "\x1c"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(25))) for _ in range(3000)]
    texts += [f"a{chr(c)}b1" for c in range(0x20, 0x3000)] + ["a" * 5000, "日本" * 3000, "ab" * 400 + "'s", "x" * 49, "'s's''s", "it's Ωμέγα ΣΑΣ"]
    library = public_library()
    want = []
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    bpe._coder.cache_clear()
    monkeypatch.setitem(__import__("sys").modules, "tokenizers", None)  # importing it now fails
    assert list(bpe.Encoder(bpe.default_path(), lexicon.compile_words([(b"the", [518])])).encode(texts)) == want
    bpe._coder.cache_clear()


def test_lexicon_takes_the_most_frequent(spark):
    d = spark.createDataFrame([(1, "b b b a a c d e f " + "x" * 100)], "doc_id long, text string")
    assert bpe.frequent_words(d, common.scratch(spark), bpe.default_path(), size=3) == [b"b", b"a", b"c"]


def test_bpe(spark, docs, empty):
    library = public_library()
    odd = ["it's we'll", "<|endoftext|> a<|startoftext|>", "", "Σας ΣΑΣ", "İ ı", "a\x1cb\xa0d", "x" * 300, "12 ¼ ...!!", "日本 テ", "é", "“q” – …", "ǅ ẞ", "AbC!!'s", "word " * 3000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    want = []
    for r in d.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode(d, common.scratch(spark), outputs=("ids_sha256", "decoded_sha256")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encode(empty, common.scratch(spark)).collect() == []


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(5)
    ws = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(300)})
    data = lexicon.compile_words([(w, [len(w), i]) for i, w in enumerate(ws)])
    lex = lexicon.Lexicon(data)
    assert lex.find(ws).tolist() == list(range(len(ws)))
    other = [w for w in {bytes(rng.choices(b"abcd", k=4)) for _ in range(100)} if w not in ws]
    assert (lex.find(other) == -1).all()
    rights = {frozenset(w[len(p) :] for w in ws if w.startswith(p)) for w in ws for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lex.final) == len(rights)
    assert (lexicon.Lexicon(lexicon.compile_words([])).find([b"a", b""]) == -1).all()


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((120, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(200 + i, [float(x) for x in base[i % 10] + rng.standard_normal(16) * 0.12]) for i in range(60)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]  # copies
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0, None] + [0.0] * 14), (403, [float("nan")] * 16), (404, [float("inf")] + [0.0] * 15), (405, []), (406, [1.0, 2.0]), (7, rows[7][1])]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_embedding_dedup(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    pad = lambda v: np.array([*v, *[0.0] * (16 - len(v))])
    live = [i for i, (_, v) in enumerate(rows) if good(v) and any(v)]
    units = {i: pad(rows[i][1]) / np.linalg.norm(pad(rows[i][1])) for i in live}
    links = {i: {j for j in live if j != i and units[i] @ units[j] >= 0.95} for i in live}
    want = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        low = min(rows[j][0] for j in seen)
        want.append((d, len(links.get(i, ())), low, d == low))
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, common.scratch(spark)).collect())
    assert sum(w[1] for w in want) > 900 and len(got) == len(want)
    assert sum(a == b for a, b in zip(got, sorted(want), strict=True)) >= 0.98 * len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, sorted(want), strict=True))
    assert embedding_dedup.near_duplicates(df.where("false"), common.scratch(spark)).collect() == []


def test_embedding_settings_promise():
    for n in (10, 10**4, 10**6, 10**9):
        k, tables = embedding_dedup.settings(n)
        assert (1 - embedding_dedup.agreement(0.95) ** k) ** tables <= 1.01e-3 and 2 <= tables < 2000


def test_topk_search(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if good(v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in scaled if i % 10 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in scaled if i != q)[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    got = topk_search.search(df, df.where("vec_id % 10 = 0"), common.scratch(spark))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    few = df.where("vec_id in (0, 1, 2)")
    assert topk_search.search(few, few, common.scratch(spark)).count() == 6
    assert topk_search.search(df.where("false"), df, common.scratch(spark)).collect() == []


def test_licenses(spark, docs, empty):
    t = licenses.TEMPLATES
    rng = random.Random(3)
    texts = [None, "", "MIT", "x " + t["mit"], t["gpl-header"] + " and more", ("pad " * 3000) + t["bsd"].upper(), " ".join(t["mit-grant"].split()[:12]), t["apache-2.0-header"], t["bsd-3-clause-text"]]
    for _ in range(60):  # edited and partial copies inside other words
        w = t[rng.choice(sorted(t))].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(rng.choices(VOCABULARY, k=rng.randrange(30)) + w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)] + rng.choices(VOCABULARY, k=rng.randrange(30))))
    rows = [(i, x, "a") for i, x in enumerate(texts)] + [(None, t["mit"], "a"), (3, "x " + t["mit"], "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumn("key", F.lit("clash"))
    got = licenses.scan(d).collect()

    def grams(x):
        w = [y.lower() for y in words(x)]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = []
    for i, x, _ in rows:
        g = grams(x)
        for k, body in t.items():
            own = set(grams(body))
            if own and 100 * len(own & set(g)) >= 80 * len(own):
                want.append((i, k, len(own & set(g)), len(own), 1 + min(n for n, y in enumerate(g) if y in own)))
    hits = {tuple(r) for r in got}
    assert hits <= set(want) and len(got) >= 0.98 * len(want) > 30  # nothing extra; the bands may miss a share
    assert sum(tuple(r)[:2] == (3, "mit") for r in got) == 2 and (None, "mit") in {tuple(r)[:2] for r in got}
    assert licenses.scan(empty).collect() == [] and licenses.scan(docs, {}).collect() == []


def labelled(spark, seed=9, n=400):
    """Good and junk texts; a toxic word family in some; labels for most."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        junk, toxic = i % 6 == 0, i % 5 == 1
        w = [rng.choice(VOCABULARY) + (rng.choice(["***", "$$$", "%%%"]) if junk else "") for _ in range(rng.randrange(20, 160))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = "vile" + rng.choice(["a", "ous", "ness", "st", "ly"])
        rows.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "no id here"), rows[5]]
    labels += [(None, 1, 0), (n + 77, 0, 1), (1, None, None), labels[0]]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("_other", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,label,junk", [(quality.score_quality, "quality", lambda i: int(i % 6 != 0)), (toxicity.score_toxicity, "toxic", lambda i: int(i % 5 == 1))])
def test_classifiers(spark, score, label, junk):
    docs, labels = labelled(spark)
    out = score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r._score <= 1 for r in out) and all(r._predicted == (r._score >= 0.3) for r in out)
    held = [r for r in out if r._held_out and r.doc_id < 400]
    assert sum(r._predicted == junk(r.doc_id) for r in held) >= 0.9 * len(held) > 30
    few = score(docs.limit(5), labels.where("doc_id < 8")).collect()  # too few labels: the rate
    assert len({r._score for r in few}) == 1
    assert score(docs.where("false"), labels).collect() == []


def test_windows_cover_every_word():
    for n in [0, 1, 47, 48, 49, 86, 87, 500]:
        s = gru.windows(n)
        assert set(range(n)) == {i for a in s.tolist() for i in range(a, min(a + gru.WINDOW, n))} and (n == 0 or s[-1] < n)


def test_gradients():
    rng = np.random.default_rng(0)
    net = gru.Net(np.arange(1, 5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    words, rows = net.lookup(np.arange(1, 10, dtype=np.uint64), [b"w%d" % i * 2 for i in range(9)]), np.array([[0, 1, 2, 3], [4, 5, -1, -1], [6, 7, 8, -1]])
    y, drop = np.array([1.0, 0, 1]), np.arange(9) == 1
    loss = lambda: np.logaddexp(0, np.where(y > 0, -1, 1) * net.run(net.gates(net.inputs(words, drop)), rows)).sum()
    x = net.inputs(words, drop)
    logit, memory = net.run(net.gates(x), rows, keep=True)
    g, dg = net.backward(1 / (1 + np.exp(-logit)) - y, memory, 9)
    dg = dg.transpose(1, 0, 2)
    g["wx"] = np.matmul(np.broadcast_to(x.T, (2, *x.T.shape)), dg)
    g |= net.inputs_back(words, np.matmul(dg, net.p["wx"].transpose(0, 2, 1)).sum(0), drop)
    for name in ("wx", "uh", "att", "v", "out", "word", "gram"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        if name in ("word", "gram"):
            at = ({"word": 3, "gram": int(words.flat[2])}[name], 2)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-2 and (name != "gram" or g[name][at] != 0), name


def test_network_against_a_plain_loop():
    """The score of a text is the largest logit of its windows, each computed word by word here."""
    rng = np.random.default_rng(4)
    vocabulary = [b"w%d" % i for i in range(60)]
    keys = textkit.Words(vocabulary).hashes()
    net = gru.Net(keys[:20])
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in net.p.items()}
    texts = [b" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 47, 48, 49, 130)] + [b"", b"  "]
    p, h, sig = net.p, gru.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def word_input(w):
        at = np.flatnonzero(keys == textkit.Words([w]).hashes()[0])
        own = p["word"][at[0] + 1] if at[0] < 20 else np.zeros(gru.WORD)
        marked, found = b"^" + w + b"$", []
        for size in gru.GRAMS:
            found += [gru.grams([w])[0]] if size == gru.GRAMS[0] else []
            assert len(marked) >= 2
        return np.concatenate([own, p["gram"][found[0]].sum(0) / np.sqrt(len(found[0]))])

    def direction(xs, k):
        state, out = np.zeros(h), []
        for x in xs:
            a, u = x @ p["wx"][k] + p["bx"][k, 0], state @ p["uh"][k]
            z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            n = np.tanh(a[2 * h :] + r * u[2 * h :])
            state = (1 - z) * n + z * state
            out.append(state)
        return out

    def window(ws):
        xs = [word_input(w) for w in ws]
        both = np.concatenate([direction(xs, 0), direction(xs[::-1], 1)[::-1]], 1)
        e = np.exp(np.tanh(both @ p["att"]) @ p["v"])
        return (e / e.sum()) @ both @ p["out"] + p["b"][0]

    want = []
    for t in texts:
        ws = t.split()
        want.append(max((window(ws[a : a + gru.WINDOW]) for a in gru.windows(len(ws)).tolist()), default=-np.inf))
    assert np.allclose(gru.Scorer(net).logits(texts), want, atol=1e-4)


def test_quality_vectors_against_a_plain_loop():
    texts = [b"one two*** three two\n| one", b"two two two", b"", b"three one rare"]
    pieces = [[b"one", b"two", b"***", b"three", b"two", b"|", b"one"], [b"two"] * 3, [], [b"three", b"one", b"rare"]]
    code = lambda w: textkit.Words([w]).hashes()[0]
    names = [b"one", b"two", b"three", b"***"]
    words = np.sort(np.array([code(w) for w in names], np.uint64))
    row = {w: int(np.flatnonzero(words == code(w))[0]) for w in names}

    def index(w, turn=0):
        h, v = int(code(w)), np.zeros(quality.DIM)
        sign = 1.0 if h >> 16 & 1 else -1.0
        v[((h & (quality.DIM - 1)) + turn) % quality.DIM] += sign
        v[((h >> 8 & (quality.DIM - 1)) + turn) % quality.DIM] -= sign
        return v

    sums = np.zeros((4, quality.DIM))
    for p in pieces:
        for i, w in enumerate(p):
            for d in (-2, -1, 1, 2):
                if w in row and 0 <= i + d < len(p):
                    sums[row[w]] += index(p[i + d], int(d > 0))
    assert np.allclose(quality.contexts(texts, words), sums)
    vectors = quality.scaled(sums)
    for p, got in zip(pieces, quality.features(texts, words, vectors), strict=True):
        x = np.array([vectors[row[w]] if w in row else index(w) * 0.5**0.5 for w in p]).reshape(len(p), quality.DIM)
        step = x[1:] - x[:-1]
        want = np.concatenate([x.mean(0), x.std(0), np.sqrt((step * step).sum(0) / max(len(step), 1))]) if p else np.zeros(3 * quality.DIM)
        assert np.allclose(got, want, atol=1e-3)


def test_quality_rests_on_the_vectors(spark):
    """Without the random-indexing vectors the network can't tell junk; with them it can."""
    docs, labels = labelled(spark, n=600)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id is not None}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and r.quality is not None}
    words = quality.vocabulary(docs)
    vectors = quality.word_vectors(docs, words)
    ids = sorted(y)
    x, truth = quality.features([texts[i] for i in ids], words, vectors).astype(float), np.array([y[i] for i in ids], float)
    train = np.arange(len(ids)) % 3 > 0
    right = lambda x: ((quality.Network(x[train], truth[train]).score(x[~train]) >= 0.3) == truth[~train]).mean()
    assert right(x) >= 0.95 and right(np.zeros_like(x)) <= 0.9


def test_jaccard_links(spark, docs):
    links, classes = jaccard_join.jaccard_links(docs, common.scratch(spark))
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id is not None and (s := shingle_set(r.text)):
            sets.setdefault(frozenset(s), r.doc_id)
            sets[frozenset(s)] = min(sets[frozenset(s)], r.doc_id)
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(sets.items(), 2) if 100 * (n := len(a[0] & b[0])) >= 80 * (len(a[0]) + len(b[0]) - n)}
    got = [tuple(r) for r in links.collect()]
    assert {p for p in got if max(p) < jaccard_join.UNNAMED} == want and len(got) == len(set(got)) and want
    assert classes.count() == docs.count()


def test_jaccard_long_lists(spark):
    """A passage that many unlinked documents share, a group of near copies, and documents made of shared passages only."""
    rng = random.Random(8)
    passages = [" ".join(rng.choices(VOCABULARY, k=30)) for _ in range(4)]
    rows = [passages[i % 4] + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(4, 60))) for i in range(120)]
    group = rng.choices(VOCABULARY, k=120)
    for _ in range(60):
        w = list(group)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [" ".join(rng.sample(passages, 3)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    sets, root = [shingle_set(t) for t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, common.scratch(spark)).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_clashing_names(spark):
    """Columns named like results give way, all others are passed on whatever their names."""
    d = spark.createDataFrame([(i, f"text {i} " * 20, "s", 5) for i in range(4)], "doc_id long, text string, source string, _id int")
    d = d.withColumns({c: F.lit("clash") for c in ("_s", "_null", "_at", "_row", "_marks", "_score", "_copies", "_kept", "_known", "_predicted")})
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality.score_quality(d, labels), toxicity.score_toxicity(d, labels), substring_dedup.remove_repeats(d, common.scratch(spark)), mixing.mix_sources(d, common.scratch(spark))):
        assert len(set(out.columns)) == len(out.columns) and {"_id", "_s", "_marks", "_row"} <= set(out.columns) and [r._s for r in out.collect()] == ["clash"] * 4
    assert mixing.emit(d, common.scratch(spark)).columns == d.columns


def test_topk_blocks_and_bounds(spark):
    """More rows than a block holds, more queries than a group, null ids and huge components; clustered vectors leave most annuli out."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8)) * 4
    x = centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 8)) * 0.05
    x[:700] = x[0]  # one vector in many rows
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    stats = {}
    got = topk_search.search(df, df.where("vec_id % 5 = 0"), common.scratch(spark), stats=stats).collect()
    m = np.floor(256 * x).astype(np.int64)
    want = set()
    for q in range(0, 3000, 5):
        s = m @ m[q]
        s[q] = -(10**12)
        want |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate(np.lexsort((np.arange(3000), -s))[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert stats["visited_share"] < 0.5
    big = spark.createDataFrame([(1, [1e10, 1.0]), (2, [1e300, -1e300]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert topk_search.search(big, big, common.scratch(spark)).count() == 6


def test_embedding_large_bucket(spark, monkeypatch):
    """Buckets of more rows than a cell takes: parts and their pairs give the same links; no vector is lost by the sketches."""
    monkeypatch.setattr(embedding_dedup, "PART", 64)
    rng = np.random.default_rng(6)
    x = rng.standard_normal(24) + rng.standard_normal((300, 24)) * 0.1
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(None, [float(y) for y in x[0]]), (900, [1e300] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = np.array([v for _, v in rows]) / np.abs([v for _, v in rows]).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = embedding_dedup.near_duplicates(df, common.scratch(spark)).collect()
    links = {r.vec_id: r.n_links for r in got}
    assert all(links[i] <= n for (i, _), n in zip(rows, want, strict=True)) and sum(links.values()) >= 0.995 * want.sum() > 10_000


def test_sketch_bound():
    p = math.acos(0.95) / math.pi
    d = embedding_dedup.far()
    assert sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(d + 1, 65)) <= 1e-6 and d < 24


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (5, 5), (9, 8), (8, 7), (7, 6), (6, 3)], "a long, b long")
    assert {tuple(r) for r in common.components(e, common.scratch(spark)).collect()} == {(i, 1) for i in (1, 2, 3, 6, 7, 8, 9)} | {(4, 4), (5, 4)}
    assert common.components(e.where("false"), common.scratch(spark)).collect() == []
