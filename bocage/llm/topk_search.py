"""Exact top-k by integer inner product over a bit-sliced index.

Method.  Components are floor(1024 x).  A block of vectors is indexed as bitmaps: slice b of
attribute d has a bit per vector, for the components shifted right by ``DROP`` bits.  For a
query, the weights are quantised and written in signed binary digits; every digit adds the
slices of its attribute, shifted, to one bit-sliced sum (a minus digit adds the complement,
which differs by the same constant for all vectors).  Sums are made by carry-save adders over
whole bitmaps, three bitmaps into two.  The k-th largest sum is then found from the most
significant slice downward.  What was cut off bounds the error of a sum, so rows within that
bound of the k-th sum are kept, and only these boundary rows are scored exactly.

Vectors with components so large that a 64-bit sum could overflow stay outside the index.
They are scored against each query, and such queries against each vector, in floating point
with a bound of its error; rows within that bound of the k-th are scored in whole numbers of
any length.

Scale.  Queries are taken in blocks of about ``QUERY_ROWS``, so what a task holds of them is
bounded; all vectors pass in blocks of ``BLOCK_ROWS`` for each block of queries.  A block
returns at most k rows per query (exact within the block), which are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 1024
DROP = 4  # low bits of a component outside the index
COARSE = 2  # low bits of a query weight outside the index
BLOCK_ROWS = 16_384
LEAST_TASKS = 12  # fewer partitions than that are never made of more
QUERY_ROWS = 2_048
LARGEST = 1 << 30  # components of the index stay below, and sums of products below its square times 4


def _signed_digits(w: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Non-adjacent form: (power, digit of every number), digits -1, 0, 1."""
    out, power = [], 0
    w = w.astype(np.int64).copy()
    while w.any():
        digit = np.where(w & 1, 2 - (w & 3), 0)
        out.append((power, digit))
        w = (w - digit) >> 1
        power += 1
    return out


class BitSlices:
    """Bit-sliced index of one block: ``values`` is rows x attributes."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values.astype(np.int64)
        rows, self.width = values.shape
        coarse = self.values >> DROP
        self.low = coarse.min(axis=0) if rows else np.zeros(self.width, dtype=np.int64)
        coarse -= self.low
        self.bits = max(int(coarse.max(initial=0)).bit_length(), 1)
        self.largest = np.abs(self.values).max(axis=0, initial=0)
        words = -(-rows // 64)
        self.slices = np.zeros((self.width, self.bits, words), dtype=np.uint64)
        for b in range(self.bits):
            self.slices[:, b] = self._packed((coarse >> b & 1).T.astype(bool), words)
        self.every = self._packed(np.ones((1, rows), dtype=bool), words)[0]

    @staticmethod
    def _packed(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros((len(bits), words * 8), dtype=np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sums plus a constant."""
        levels: dict[int, list[np.ndarray]] = {}
        for power, digit in _signed_digits(weights):
            some = np.flatnonzero(digit)
            if not len(some):
                continue
            minus = np.where(digit[some] < 0, ~np.uint64(0), np.uint64(0))[:, None]
            for b in range(self.bits):
                levels.setdefault(power + b, []).append(self.slices[some, b] ^ minus)
        out: list[np.ndarray] = []
        level, words = 0, len(self.every)
        while levels:
            parts = levels.pop(level, [])
            own = np.concatenate(parts) if parts else np.zeros((0, words), dtype=np.uint64)
            while len(own) > 1:
                if len(own) == 2:
                    a, b = own
                    own, carry = (a ^ b)[None], (a & b)[None]
                else:
                    n = len(own) // 3
                    a, b, c = own[:n], own[n : 2 * n], own[2 * n : 3 * n]
                    half = a ^ b
                    own, carry = np.concatenate([half ^ c, own[3 * n :]]), (a & b) | (half & c)
                levels.setdefault(level + 1, []).append(carry)
            out.append(own[0] if len(own) else np.zeros(words, dtype=np.uint64))
            level += 1
        return out

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but the query's own, ties to smaller ids."""
        allowed = self.every.copy()
        for r in np.flatnonzero(self.ids == query_id):
            allowed[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        if int(np.bitwise_count(allowed).sum()) <= k:
            rows = self._rows(allowed)
        else:
            weights = query + (1 << COARSE - 1) >> COARSE
            slices = self.sums(weights)
            # the k-th largest sum, bit by bit; `level` holds rows equal to it so far
            above, level, kth = 0, allowed, 0
            for i in range(len(slices) - 1, -1, -1):
                ones = level & slices[i]
                n = int(np.bitwise_count(ones).sum())
                if above + n >= k:
                    level, kth = ones, kth | 1 << i
                else:
                    above, level = above + n, level & ~slices[i]
            unit = 1 << DROP + COARSE
            error = int((np.abs(weights) << COARSE).sum()) * ((1 << DROP) - 1) + 2 * int(
                (np.abs(query - (weights << COARSE)) * self.largest).sum()
            )
            rows = self._rows(self._at_least(slices, kth - (-(-error // unit)), allowed))
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    def _at_least(self, slices: list[np.ndarray], bound: int, allowed: np.ndarray) -> np.ndarray:
        if bound <= 0:
            return allowed
        if bound.bit_length() > len(slices):
            return np.zeros_like(allowed)
        more, level = np.zeros_like(allowed), allowed
        for i in range(len(slices) - 1, -1, -1):
            if bound >> i & 1:
                level = level & slices[i]
            else:
                more |= level & slices[i]
                level = level & ~slices[i]
        return more | level


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, width, value, raw``; rows that take no part are left out.  value (array<int>):
    floor(1024 x); null if that is beyond the index, and then raw (array<double>) has x."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN sorts above all numbers
    limit = F.least(F.lit(float(LARGEST)), 2 * LARGEST / F.sqrt(F.size(x))) / SCALE - 1
    fits = F.forall(x, lambda x: F.abs(x) < limit)
    scaled = F.transform(x, lambda x: F.floor(x * SCALE)).cast("array<int>")
    return vectors.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.size(x).alias("width"),
        F.when(fits, scaled).alias("value"), F.when(~fits, x).alias("raw"),
    )


def _floored(raw: np.ndarray) -> np.ndarray:
    """floor(1024 x) as doubles; infinite where that is beyond them."""
    with np.errstate(over="ignore"):
        return np.floor(np.asarray(raw, dtype=np.float64) * SCALE)


def _whole(value, raw) -> list[int]:
    """floor(1024 x) as Python integers; of a double above 2^53 all digits are whole."""
    if raw is None:
        return [int(x) for x in value]
    return [int(x) * SCALE if abs(x) > 2.0**53 else int(np.floor(x * SCALE)) for x in raw]


def wide_top(
    ids: np.ndarray, rows: np.ndarray, whole: Callable, query_id: int, query: list[int], k: int
) -> list[tuple[int, int]]:
    """(id, exact score) of the k best rows but the query's own, ties to smaller ids.  ``rows``:
    the floored components as doubles; ``whole(i)``: those of row i as integers."""
    some = np.flatnonzero(ids != query_id)
    if len(some) > k:
        with np.errstate(all="ignore"):
            q = np.array([float(x) if abs(x) < 1 << 1023 else np.inf for x in query])
            about = rows[some] @ q
            # each product and each partial sum is rounded once
            error = (np.abs(rows[some]) @ np.abs(q)) * (2.0**-51 * (len(q) + 2))
            if np.isfinite(about).all() and np.isfinite(error).all():
                least = np.partition(about - error, -k)[-k]
                some = some[about + error >= least]
    scores = [(int(ids[i]), sum(a * b for a, b in zip(whole(i), query))) for i in some]
    return sorted(scores, key=lambda r: (-r[1], r[0]))[:k]


def ordered(score: int) -> tuple[int | None, int, bytes | None]:
    """score, beyond, wide: columns that sort as the score does; score is None beyond 64 bits."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    size = (abs(score).bit_length() + 7) // 8
    raw = abs(score).to_bytes(size, "big")
    return (None, size, raw) if score > 0 else (None, -size, bytes(255 - b for b in raw))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for quantised queries against quantised vectors.

    Left out: null id or embedding; null, NaN or infinite components.  A score beyond 64 bits
    is null; its row has the rank of the whole score.  A query sees vectors of its own length only, and no row with its own id.  Rows
    that share an id are candidates of their own; queries that share an id are answered once
    each, ranks going on by id and score together.  Ties: smaller id.  Fewer than k
    candidates: all of them.  Empty tables: no rows.
    """
    spark = queries.sparkSession
    asked = saved(queries.dropDuplicates(), "queries")
    n = max(1, -(-asked.count() // QUERY_ROWS))
    parts = None
    for block in range(n):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).collect()  # one bounded block
        by_width: dict[int, list] = {}
        for r in some:
            by_width.setdefault(r.width, []).append((r.vec_id, r.value, r.raw))
        sent = spark.sparkContext.broadcast(by_width)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for frame in frames:
                held.append(frame)
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield from answers(pd.concat(held), sent.value)
                    held = []
            if held:
                yield from answers(pd.concat(held), sent.value)

        def answers(frame: pd.DataFrame, by_width: dict) -> Iterator[pd.DataFrame]:
            for w, asked_ in by_width.items():
                own = frame[frame["width"] == w]
                if not len(own):
                    continue
                inside = own[own["raw"].isna()]
                outside = own[own["raw"].notna()]
                plain = [(q, np.array(v, dtype=np.int64)) for q, v, raw in asked_ if raw is None]
                if len(inside) and plain:
                    index = BitSlices(
                        inside["vec_id"].to_numpy(), np.stack(inside["value"].to_numpy()).reshape(len(inside), w)
                    )
                    found = [(q, *index.top(q, v, k)) for q, v in plain]
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                            "vec_id": np.concatenate([f[1] for f in found]),
                            "score": pd.array(np.concatenate([f[2] for f in found]), dtype="Int64"),
                            "beyond": 0,
                            "wide": None,
                        }
                    )
                if len(outside):
                    yield from wide_answers(outside, [(q, v, raw) for q, v, raw in asked_ if raw is None])
                if any(raw is not None for _, _, raw in asked_):
                    yield from wide_answers(own, [(q, v, raw) for q, v, raw in asked_ if raw is not None])

        def wide_answers(own: pd.DataFrame, asked_: list) -> Iterator[pd.DataFrame]:
            ids, values, raws = own["vec_id"].to_numpy(), own["value"].to_numpy(), own["raw"].to_numpy()
            rows = np.stack([np.asarray(v, dtype=np.float64) if r is None else _floored(r) for v, r in zip(values, raws)])
            out = [
                (q, i, *ordered(score))
                for q, v, raw in asked_
                for i, score in wide_top(ids, rows, lambda i: _whole(values[i], raws[i]), q, _whole(v, raw), k)
            ]
            frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "beyond", "wide"])
            yield frame.assign(score=pd.array([r[2] for r in out], dtype="Int64"))

        part = vectors.mapInPandas(run, "query_id long, vec_id long, score long, beyond int, wide binary")
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), F.desc("wide"), "vec_id")
    return parts.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(
        F.col("rank") <= k
    )


def in_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Small partitions put together, so that a block is worth its overhead, but to no fewer than
    ``rows / BLOCK_ROWS``: the number of tasks grows with the vectors."""
    return vectors.coalesce(max(LEAST_TASKS, -(-rows // BLOCK_ROWS)))


def op2(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = quantised(table)
    return top_k(vectors.where("vec_id % 100 = 0"), in_blocks(vectors, table.count()))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
