"""Number of greedy word pieces of a text, without building the pieces.

Method.  The vocabulary is a trie over bytes.  Every node has a failure link and the number
of pieces that are popped on the way along it, worked out once in breadth-first order.  A
word is then read once from left to right: each byte follows a child, or failure links until
one has that child, adding what they pop.  The time is linear in the length of the word.

The vocabulary is that of a byte-level tokenizer: a piece that begins a word starts with a
space, any other continues one.  All 256 single bytes are pieces, so every word has pieces.
Counts are remembered by word in each Python worker, up to a fixed number of words.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 500_000


def byte_pieces(path: str) -> set[bytes]:
    """Pieces of a byte-level vocabulary file as bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    return {bytes(byte[c] for c in w) for w in words if all(c in byte for c in w)}


class Automaton:
    """Trie with failure links; ``count`` is the number of longest-match pieces of a word."""

    def __init__(self, pieces: set[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces | {bytes([b]) for b in range(256)}:
            node = 0
            for b in piece:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = self.child[node][b]
            ends[node] = True
        self.fail = [0] * len(self.child)
        self.pops = [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, below in self.child[node].items():
                queue.append(below)
                if ends[below]:  # the piece itself is popped, what follows starts afresh
                    self.pops[below] = 1
                    continue
                popped, at = self.pops[node], self.fail[node]
                while b not in self.child[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                self.pops[below], self.fail[below] = popped, self.child[at][b]
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for b in word:
            while b not in child[node]:
                total += pops[node]
                node = fail[node]
            node = child[node][b]
        while node:
            total += pops[node]
            node = fail[node]
        return total

    def count_text(self, raw: bytes | None) -> tuple[int, int]:
        """Words (runs without ASCII blanks) and pieces of a text; each word has a space before it."""
        words = raw.split() if raw else []
        known, total = self.known, 0
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in words:
            n = known.get(word)
            if n is None:
                n = known[word] = self.count(b" " + word)
            total += n
        return len(words), total


@cache
def _automaton(path: str) -> Automaton:
    return Automaton(byte_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row.

    Null or blank text: 0 and 0.  Null and repeated ids: kept.  Empty table: no rows.  Other
    columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(vocabulary)
        for frame in frames:
            rows = [automaton.count_text(raw) for raw in frame["raw"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")
            yield out.assign(doc_id=frame["doc_id"].astype("Int64"))[["doc_id", "n_words", "n_tokens"]]

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw")
    )
    return rows.mapInPandas(run, "doc_id long, n_words long, n_tokens long")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
