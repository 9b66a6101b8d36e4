"""Exact encoding of a corpus with a public byte-level BPE vocabulary.

Per-prefix dynamic programming: for every prefix of a pre-token exactly one token can be the last of the prefix's
encoding. An automaton with suffix links over the vocabulary lists the tokens that end at each position, longest first;
a candidate is right if it is compatible with the last token of the prefix that it leaves, that is if the merges keep
the two tokens apart. Following the stored last tokens backwards from the end emits the ids. Time is linear in the text
times the few tokens that end at a position; no merge queue is kept.

Rank files are read on the driver (under 1 MB each, whatever the corpus) and broadcast, so that executors need no copy.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every entry point.
TOKENIZERS = os.environ.get("SKYLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens kept per worker, and the longest one kept.
CACHE, CACHE_LEN = 400_000, 64
#: Rows of a result batch.
ROWS = 512


class PrefixEncoder:
    """Encoder of one rank file (``base64-token rank`` per line)."""

    def __init__(self, ranks: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.token = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}
        self.compatible = lru_cache(maxsize=1 << 20)(self._compatible)
        self.auto = ahocorasick.Automaton()
        for t, i in self.rank.items():
            if self._merged(t) == [i]:  # a token that its own bytes never merge to can be in no encoding
                self.auto.add_word(t.decode("latin-1"), (len(t), i))
        self.auto.make_automaton()

    def _merged(self, text: bytes) -> list[int]:
        """Merges of a short byte string by rank; only used on one or two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        return self._merged(self.token[a] + self.token[b]) == [a, b]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, i) in self.auto.iter(data.decode("latin-1")):
            at, left = end + 1, end + 1 - size
            if last[at] < 0 and (left == 0 or last[left] >= 0 and self.compatible(last[left], i)):
                last[at], begin[at] = i, left
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[n])
            n = begin[n]
        return out[::-1]

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts give an empty list."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for p in self.split(text):
            got = kept.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8", "replace"))
                if len(p) <= CACHE_LEN:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[p] = got
            out += got
        return out


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(ranks: bytes) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(ranks)
    return _ENCODERS[key]


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _run(docs: DataFrame, cols: dict[str, Column], tokenizer: str, folder: str | None, out: str, kind: str, arrow: pa.DataType, result) -> DataFrame:
    """``cols`` and the encoder's result on the text, in one pass over the rows; no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(tokenizer, folder))
    src = docs.select(*[c.alias(k) for k, c in cols.items()])
    keep = [k for k in cols if k != "_text"]
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep) + f", `{out}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                got = pa.array([result(enc, t) for t in part.column("_text").to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], got], names=[*keep, out])

    return src.mapInArrow(run, schema)


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per input row, repeated rows included; no shuffle.

    Empty and null texts give an empty list; strings of special tokens inside a text are ordinary text. A null key stays
    null. Other columns are not read.
    """
    cols = {"doc_id": F.col(id_col).cast("long"), "_text": F.col(text_col).cast("string")}
    return _run(docs, cols, tokenizer, folder, "ids", "array<int>", pa.list_(pa.int32()), lambda e, t: e.ids(t))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, keep..., n_tokens)`` by the same encoder; 0 for empty and null texts. ``keep``: further columns by name."""
    cols = {"doc_id": F.col(id_col).cast("long"), **(keep or {}), "_text": F.col(text_col).cast("string")}
    return _run(docs, cols, tokenizer, folder, "n_tokens", "long", pa.int64(), lambda e, t: len(e.ids(t)))
