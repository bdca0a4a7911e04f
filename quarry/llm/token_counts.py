"""Token counts of whole texts with a public sentencepiece model: Arrow batches in, lengths out.

Safe boundaries. In this model no piece has the space mark after another character, so no merge crosses the place before
a run of spaces. A text that has single spaces only is therefore cut there, and the pieces of a part do not depend on its
neighbours: parts are counted once and remembered (in a bounded table), the rest in batches of about equal bytes. Texts with
double, leading or trailing spaces or the mark itself are cut, from LONG bytes on, at spaces that stand between two other
characters, and encoded part by part.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, textkit
from quarry.llm.hashtable import HashTable

LIMIT = 4096
#: Texts from so many bytes on are encoded in parts.
LONG = 1 << 15
SCHEMA = "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def _loaded(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model), HashTable(21)


MARK = "▁".encode()


def _plain(t: bytes) -> bool:
    return bool(t) and b"  " not in t and t[:1] != b" " and t[-1:] != b" " and MARK not in t


def _lengths(sp, parts: list[bytes]) -> list[int]:
    return [len(x) for x in sp.encode([p.decode() for p in parts], num_threads=1)]


def _cut(t: bytes) -> list[bytes]:
    """Parts of about LONG bytes whose token counts add up to that of t; the space at a cut is the next part's own prefix."""
    parts, begin = [], 0
    while len(t) - begin > LONG:
        at = t.find(b" ", begin + LONG)
        while at > 0 and (t[at - 1 : at] == b" " or t[at + 1 : at + 2] in (b" ", b"") or t[at - 3 : at] == MARK or t[at + 1 : at + 4] == MARK):
            at = t.find(b" ", at + 1)
        if at < 0:
            break
        parts.append(t[begin:at])
        begin = at + 1
    return [*parts, t[begin:]]


class _Parts(textkit.Words):
    """Runs between single spaces: words, cut at the byte 32 alone."""

    def __init__(self, texts: list[bytes]):
        self.buf = b" ".join(texts) + b" " if texts else b""
        data = np.frombuffer(self.buf, np.uint8)
        space = data == 32
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self._data, self._space = data, space


def counts(texts: list[bytes], model: str) -> np.ndarray:
    """Tokens of each text, without begin, end or other added tokens."""
    sp, seen = _loaded(model)
    out = np.zeros(len(texts), np.int64)
    plain = [i for i, t in enumerate(texts) if _plain(t)]
    for i in set(range(len(texts))) - set(plain):
        if texts[i]:
            out[i] = sum(_lengths(sp, _cut(texts[i])))
    for a, b in textkit.groups([len(texts[i]) for i in plain]):
        some = plain[a:b]
        w = _Parts([texts[i] for i in some])
        keys, inverse, at = _distinct(w.hashes())
        n = seen.find(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            parts = [w.buf[s:e] for s, e in zip(w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), strict=True)]
            n[new] = [x for c, d in textkit.groups([len(p) for p in parts], 1 << 18) for x in _lengths(sp, parts[c:d])]
            if not seen.room(len(new)):
                seen.clear()
            if seen.room(len(new)):
                seen.add(keys[new], n[new])
        total = np.concatenate([[0], np.cumsum(n[inverse], dtype=np.int64)])
        out[some] = total[w.first[1:]] - total[w.first[:-1]]
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return keys, inverse, at


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows give repeated rows. Other columns
    of docs, whatever their names, play no part. An empty table gives an empty result.
    """
    model = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            n = counts(texts, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
