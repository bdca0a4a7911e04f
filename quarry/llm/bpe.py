"""BPE encoding and decoding of whole texts as the tokenizers library does it with a word-end vocabulary.

Frequent words of the corpus are compiled with their ids into a minimal acyclic transducer (lexicon.py), which workers memory-map. Texts are
normalised and cut into words for many texts at once; a word's ids come from a bounded table of words met before, else from the
transducer, else from exact merging: always the pair of the lowest rank, the leftmost of equal ones, many words side by side.

The library itself encodes nothing here. Added tokens cut a text first; what stands between them is normalised (NFC, each character lower-cased by itself) and cut
by the class of its characters, contractions and all, for any Unicode text. Words of over LONG bytes are merged one by one with a heap, to the same ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, textkit
from quarry.llm.hashtable import HashTable
from quarry.llm.lexicon import Lexicon, compile_words

U = textkit.U
#: Words that the lexicon holds at most.
LEXICON = 1 << 15
LONG = 48
NONE = np.int32(1 << 30)
SPACE, LETTER, DIGIT, OTHER, SHORT = range(5)
#: The characters of the property White_Space, and the endings that an apostrophe starts.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters (ranges) and lower cases (ranges and what to add) that Unicode has since 16 and unicodedata may not have yet.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and its lower case (of all but U+0130 one character)."""
    kind, lower = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    first = {"L": LETTER, "N": DIGIT}
    for c in range(0x110000):
        ch = chr(c)
        kind[c] = first.get(unicodedata.category(ch)[0], OTHER)
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    for a, b in NEW_LETTERS:
        kind[a : b + 1] = LETTER
    for a, b, add in NEW_LOWER:
        lower[a : b + 1] = np.arange(a, b + 1) + add
    kind[WHITE] = SPACE
    return kind, lower


class Coder:
    """The vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = t
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        self.chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab[self.chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[self.chars[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._keys, self._first = np.unique(ids[:, 0] << 32 | ids[:, 1], return_index=True)
        self.ranks = HashTable(18)
        self.ranks.add(self._keys.astype(U) + U(1), self._first)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair a << 32 | b, for words too long for arrays; made when the first one comes."""
        return dict(zip(self._keys.tolist(), self._first.tolist(), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.ranks.find((a.astype(np.int64) << 32 | b).astype(U).ravel() + U(1)).reshape(a.shape)
        return np.where(r < 0, NONE, r)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a, b in textkit.groups([len(words[i]) + 8 for i in order], 1 << 16):
            some = order[a:b]
            while some and len(words[some[-1]]) > LONG:
                i = some.pop()
                out[i] = self.merge_long(words[i])
            if some:
                ids, n = self._merge([words[i] for i in some])
                for i, row, k in zip(some, ids.tolist(), n.tolist(), strict=True):
                    out[i] = row[:k]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word of any length: a heap of (rank, place) over a linked list."""
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        n, made, pairs = len(ids), self.made.tolist(), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = made[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pairs.get(ids[i] << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pairs.get(ids[before[i]] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def segments(self, text: str) -> tuple[list[str], list[str]]:
        """What stands between the added tokens of a text, and these tokens: one fewer."""
        return (self.apart.split(text), self.apart.findall(text)) if self.added else ([text], [])

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words])
        width = int(n.max())
        place = np.arange(width)
        ids = np.zeros((len(n), width), np.int32)
        inside = place < n[:, None]
        data = np.frombuffer(b"".join(words), np.uint8)
        ids[inside] = self.inner[data]
        ids[np.arange(len(n)), n - 1] = self.last[data[np.cumsum(n) - 1]]
        ranks = np.full((len(n), width), NONE, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.rank(ids[:, :-1], ids[:, 1:]), NONE)
        on = np.arange(len(n))
        while len(on):
            r = ranks[on]
            p = r.argmin(1)
            best = r[np.arange(len(on)), p]
            on, p, best, r = on[best < NONE], p[best < NONE], best[best < NONE], r[best < NONE]
            if not len(on):
                break
            m, k = ids[on], np.arange(len(on))
            m[k, p] = self.made[best]
            after = place[:-1] > p[:, None]
            m[:, :-1] = np.where(after, m[:, 1:], m[:, :-1])
            r[:, :-1] = np.where(after, r[:, 1:], r[:, :-1])
            r[:, -1] = NONE
            n[on] -= 1
            r[k, p] = np.where(p + 1 < n[on], self.rank(m[k, p], m[k, np.minimum(p + 1, width - 1)]), NONE)
            left = p > 0
            r[k[left], p[left] - 1] = self.rank(m[k[left], p[left] - 1], m[k[left], p[left]])
            ids[on], ranks[on] = m, r
        return ids, n


def normal(t: str) -> str:
    """NFC, and the one character whose lower case is two already in that form."""
    if t.isascii():
        return t
    t = t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
    return t.replace("\u0130", "i\u0307")


class Cut:
    """The words of some texts without added tokens, lower-cased: word i is text[starts[i]:ends[i]], text d's first word is first[d]."""

    def __init__(self, texts: list[str]):
        texts = [normal(t) for t in texts]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kinds, lower = _classes()
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self._code = code = lower[raw]
        kind = kinds[code]
        forced = kind == DIGIT
        mark = np.flatnonzero(code[:-1] == 0x27)
        mark = mark[(kind[mark + 1] == LETTER) & ((mark == 0) | (kind[mark - 1] != OTHER))]
        if len(mark):
            size, second, third = np.zeros(len(mark), np.int64), code[mark + 1], code[np.minimum(mark + 2, len(code) - 1)]
            for e in ENDINGS:
                size[(second == ord(e[0])) & ((len(e) == 1) | (third == ord(e[-1])))] = 1 + len(e)
            mark, size = mark[size > 0], size[size > 0]
            forced[mark] = forced[mark + size] = True
            kind = kind.copy()
            for k in range(3):
                kind[mark[size > k] + k] = SHORT
        stop = (np.diff(kind, prepend=SPACE) != 0) | forced
        self.starts = np.flatnonzero(stop & (kind != SPACE))
        stop = np.flatnonzero(stop)
        self.ends = np.append(stop, len(code))[np.searchsorted(stop, self.starts, "right")]
        self.first = np.searchsorted(self.starts, at)
        self.text = code.tobytes().decode("utf-32-le", "surrogatepass")

    def hashes(self) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, U)
        begin = np.cumsum(lens) - lens
        place = np.arange(lens.sum()) - np.repeat(begin, lens)
        chars = self._code[np.repeat(self.starts, lens) + place].astype(U)
        constants = textkit.series(max(int(lens.max()), 64), 13)
        with np.errstate(over="ignore"):
            return textkit.mix(np.add.reduceat((chars + U(1)) * constants[place], begin) + lens.astype(U) * U(0xD6E8FEB86659FD93))

    def words(self, at: np.ndarray) -> list[bytes]:
        return [self.text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


@cache
def _coder(path: str) -> Coder:
    return Coder(path)


class Encoder:
    """Encodes texts; keeps what it knows of words, up to half of 2**bits of them."""

    def __init__(self, path: str, lexicon: bytes | None = None, bits: int = 18):
        self.coder, self.lexicon = _coder(path), Lexicon(lexicon) if lexicon else None
        self.table = HashTable(bits)
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.ids, self.pieces, self.sizes = [], [], np.zeros(1 << 12, np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        number = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1)
        known = {}
        for i in np.flatnonzero(number >= 0).tolist():
            lo, hi = self.lexicon.ends[number[i] : number[i] + 2].tolist()
            known[i] = self.lexicon.ids[lo:hi].tolist()
        rest = np.flatnonzero(number < 0).tolist()
        known |= dict(zip(rest, self.coder.merge([words[i] for i in rest]), strict=True))
        base, tokens = len(self.ids), self.coder.tokens
        self.table.add(keys, np.arange(base, base + len(keys)))
        while len(self.sizes) < base + len(keys):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        for i in range(len(words)):
            ids = known[i]
            self.ids.append(" ".join(map(str, ids)))
            self.pieces.append(" ".join([tokens[t] for t in ids]))
            self.sizes[base + i] = len(ids)

    def encode(self, texts: list[str]):
        """Per text (number of tokens, ids joined by a space, decoded text)."""
        for a, b in textkit.groups([2 * len(t) for t in texts]):
            cut_up = [self.coder.segments(t) for t in texts[a:b]]
            parts = self._parts([p for some, _ in cut_up for p in some])
            for some, tokens in cut_up:
                n, ids, pieces = map(list, zip(*(next(parts) for _ in some), strict=True))
                if tokens:
                    between = [*tokens, None]
                    ids = [x for i, t in zip(ids, between, strict=True) for x in (i, str(self.coder.added[t]) if t else "") if x]
                    pieces = [x for i, t in zip(pieces, between, strict=True) for x in (i, t) if x]
                    yield sum(n) + len(tokens), " ".join(ids), " ".join(pieces)
                else:
                    yield n[0], ids[0], pieces[0]

    def _parts(self, texts: list[str]):
        """The same for texts without added tokens."""
        cut = Cut(texts)
        keys, at, back = np.unique(cut.hashes(), return_index=True, return_inverse=True)
        found = self.table.find(keys)
        if (found < 0).any() and not self.table.room(int((found < 0).sum())):
            self._forget()
            found = self.table.find(keys)
            while not self.table.room(len(keys)):
                self.table = HashTable(self.table.bits + 1)
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(keys[new], cut.words(at[new]))
            found = self.table.find(keys)
        word = found[back]
        total = np.concatenate([[0], np.cumsum(self.sizes[word], dtype=np.int64)])
        word, first = word.tolist(), cut.first.tolist()
        for d in range(len(texts)):
            some = word[first[d] : first[d + 1]]
            yield int(total[first[d + 1]] - total[first[d]]), " ".join([self.ids[i] for i in some]), " ".join([self.pieces[i] for i in some])


def frequent_words(docs: DataFrame, folder: str, path: str, size: int = LEXICON, text_col: str = "text") -> list[bytes]:
    """The corpus's most frequent words of up to LONG bytes, size of them at most, ties to the smaller: all words are counted."""

    def count(batches):
        coder = _coder(path)  # the worker's own: one that came with the function would be unpickled for every task
        table, words, sums = HashTable(19), [], np.zeros(1 << 19, np.int64)

        def out():
            for a in range(0, len(words), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + (1 << 14)], pa.binary()), pa.array(sums[a : min(a + (1 << 14), len(words))])], names=["word", "n"])

        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in textkit.groups([2 * len(t) for t in texts]):
                cut = Cut([p for t in texts[a:b] for p in coder.segments(t)[0]])
                keys, at, n = np.unique(cut.hashes(), return_index=True, return_counts=True)
                found = table.find(keys)
                new = np.flatnonzero(found < 0)
                if not table.room(len(new)):
                    yield from out()
                    table.clear()
                    words.clear()
                    sums[:] = 0
                    new = np.arange(len(keys))
                    if not table.room(len(new)):
                        words += cut.words(at)
                        sums = np.concatenate([n, np.zeros(1, np.int64)])
                        yield from out()
                        words.clear()
                        sums = np.zeros(1 << 19, np.int64)
                        continue
                if len(new):
                    table.add(keys[new], np.arange(len(words), len(words) + len(new)))
                    words += cut.words(at[new])
                    found = table.find(keys)
                sums[found] += n
        yield from out()

    counts = docs.select(docs[text_col].cast("string")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.table(counts, folder, "words")
    top = common.most_frequent(counts.where(F.length("word") <= LONG), size)
    words = [bytes(w) for w in top.select("word").toArrow()["word"].to_pylist()]  # of size words at most
    common.drop(docs.sparkSession, folder, "words")
    return words


def encode(docs: DataFrame, folder: str, path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens and the outputs asked for, of ids (array), decoded, ids_sha256, decoded_sha256.

    Ids are those of the library without added tokens, truncation or padding; strings of added tokens inside a text become
    those tokens, as in the library. decoded is what the library makes of the ids, added tokens included. A null text counts as empty: no tokens, empty outputs.
    Null ids and repeated rows are rows like others; other columns play no part. An empty table gives an empty result.
    """
    path = path or default_path()
    coder = _coder(path)
    words = frequent_words(docs, folder, path, text_col=text_col)
    compiled = docs.sparkSession.sparkContext.broadcast(compile_words(list(zip(words, coder.merge(words), strict=True))))  # of LEXICON words at most
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    make = {
        "ids": lambda i, d: [int(x) for x in i.split()],
        "decoded": lambda i, d: d,
        "ids_sha256": lambda i, d: hashlib.sha256(i.encode()).hexdigest(),
        "decoded_sha256": lambda i, d: hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest(),
    }
    types = {"ids": pa.list_(pa.int32())}

    def run(batches):
        encoder = Encoder(path, compiled.value)
        for batch in batches:
            n, rows = [], {o: [] for o in outputs}
            for k, ids, decoded in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(k)
                for o in outputs:
                    rows[o].append(make[o](ids, decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(rows[o], types.get(o, pa.string())) for o in outputs)], names=["id", "n_tokens", *outputs])

    schema = ", ".join(["id bigint", "n_tokens bigint", *(f"{o} {kinds[o]}" for o in outputs)])
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, common.scratch(spark), outputs=("ids_sha256", "decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
