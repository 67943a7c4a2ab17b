"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary (a tokenizers .json whose tokens end words with ``</w>``)
becomes a trie over bytes with an end-of-word symbol. Each node has a failure
link and the number of tokens popped when it is followed, both precomputed, so
a word of n bytes takes at most 2 n steps and no piece is ever built. Words are
runs of non-separators of the text with A-Z lower-cased; a word that no
sequence of tokens covers counts as one unknown token.

The automaton depends on the vocabulary alone and is broadcast; a bounded cache
in each task keeps the counts of frequent words.

Defined cases: null and blank texts have 0 words and 0 tokens; repeated rows
and null doc_ids are ordinary rows; an empty table gives an empty result. Other columns
stay, whatever their names, but for those with the name of a new one (in any case). A very long
text is split into its words at once (about 60 bytes a word); a very long word is walked byte by byte.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, hide, show, utf8

END = 256
CACHE_WORDS = 300_000
CHUNK_BYTES = 1 << 20


def _bytes_of_characters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens as symbol tuples: bytes, with END after a word's last byte."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    letters = _bytes_of_characters()
    out = []
    for token in tokens:
        body, end = (token[:-4], (END,)) if token.endswith("</w>") and len(token) > 4 else (token, ())
        if all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *end))
    return out


class Automaton:
    """move[node * 512 + symbol] -> node; fail[node] (-1: none), popped[node]. Node 0 is the root."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        self.move: dict[int, int] = {}
        parent, symbol, is_token = [-1], [-1], [False]
        for token in tokens:
            node = 0
            for s in token:
                key = node * 512 + s
                after = self.move.get(key)
                if after is None:
                    after = self.move[key] = len(parent)
                    parent.append(node)
                    symbol.append(s)
                    is_token.append(False)
                node = after
            if node:
                is_token[node] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        for v in np.argsort(depth, kind="stable").tolist()[1:]:
            if is_token[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, s = parent[v], symbol[v]
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and z * 512 + s not in self.move:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.move[z * 512 + s], n

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match split of one word; 1 if there is none."""
        move, fail, popped = self.move, self.fail, self.popped
        node, n = 0, 0
        for s in (*word, END):
            while (after := move.get(node * 512 + s)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def count_tokens(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Columns of docs but text, then n_words, n_tokens (long)."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(vocab_path)))
    hidden, others = hide(docs, ["text"], ["n_words", "n_tokens"])
    columns = [c for c in hidden.columns if c != "text"]

    def run(batches):
        count = shared.value.count
        cache: dict[bytes, int] = {}
        for piece in chunks(batches, "text", CHUNK_BYTES):
            data, at = utf8(piece.column("text"))
            raw, at = data.tobytes(), at.tolist()
            n_words, n_tokens = [], []
            for a, b in zip(at, at[1:]):
                words = raw[a:b].lower().split()
                total = 0
                for word in words:
                    n = cache.get(word)
                    if n is None:
                        n = cache[word] = count(word)
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [*columns, "n_words", "n_tokens"])

    schema = T.StructType([*[hidden.schema[c] for c in columns], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return show(hidden.select(*columns, "text").mapInArrow(run, schema), [], others, ["n_words", "n_tokens"])
