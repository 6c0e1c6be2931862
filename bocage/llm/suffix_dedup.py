"""Remove long byte strings that already occurred: prefix doubling over sampled positions.

Every start of a ``LENGTH``-byte string is a position; its rank at length h names the h bytes
that begin there.  Ranks double by pairs: rank 2h of p is the name of (rank h of p, rank h of
p + h).  Positions whose rank is unique drop out, the others go on until LENGTH is passed.

* Lengths 1, 2, 4 ... GRAM are paired inside each document; names are 64-bit mixes of the
  pair, equal in all tasks, so that these rounds need no shuffle.
* Round GRAM in Spark.  Sorting all positions would shuffle many times the input, so one
  position speaks for its neighbours: the *anchor* of a window is the leftmost position with
  the smallest rank of length GRAM in it.  Equal windows have equal anchors at the same
  distance, so a window whose anchor has a unique rank is unique.  A *run* is the windows of
  one anchor; about one row per 35 bytes is shuffled by rank and sorted.  Runs with the same
  rank and the same bytes (a pair of 64-bit names) are equal windows throughout: all but the
  earliest run are repeats.  The earliest goes on if another run has its rank.
* Round LENGTH in Spark.  A run that goes on is cut into two halves, keyed by the rank of the
  66 or 67 bytes that all windows of the half have in common, and sent with its bytes; the
  rows are sorted by that rank.  Their windows get the rank pair (rank 64 of p, rank 64 of
  p + 36); all but the earliest are repeats.  Windows of a core that fills more than a batch
  are shuffled once more by their rank pair.

The result is exact but for collisions of 128-bit names.  A key that is common in a task is
merged there before the shuffle, so that a hot string sends a few rows per task.  What is
sent for a rank with several different runs in one task is only the fact that it repeats.
Text is shuffled by document, in whole rows; a task holds one partition's anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, keyed, saved, unused

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 1 << 18
HELD_RUNS = 1 << 20  # runs a task holds before it merges and sends them
SINGLE, REPEAT, GOES_ON, TOKEN = 0, 1, 2, 3

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit name of a pair of names."""
    x = a * _M1
    x += b
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _ranks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 32 and the 64 bytes at every position that has them."""
    rank, h, short = text.astype(np.uint64) + np.uint64(1), 1, None
    while h < 64:
        rank = _pair(rank[: max(len(rank) - h, 0)], rank[h:])
        h *= 2
        if h == GRAM:
            short = rank
    return short, rank


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    out, h = values, 1
    while 2 * h <= width:
        out = np.minimum(out[: len(out) - h], out[h:])
        h *= 2
    return np.minimum(out[: len(out) - (width - h)], out[width - h :]) if h < width else out


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of the windows of some texts: index of the text, first window << 16 | offset of its
    anchor << 8 | number of windows, rank of the anchor, name of the bytes of the whole run."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(joined) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    short, long = _ranks(joined)
    at = np.arange(len(short), dtype=np.uint64)
    lowest = _window_min((short & ~np.uint64(0xFFFFFFFF)) | at, LENGTH - GRAM + 1)
    anchor = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    p = np.flatnonzero(doc[:n] == doc[LENGTH - 1 :])  # windows inside one text
    if not len(p):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    a = anchor[p]
    # the same anchor in another text is the same position, so texts split runs too
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[p[1:]] != doc[p[:-1]])])
    last = np.r_[first[1:], len(p)] - 1
    p0, p1 = p[first], p[last]
    name = [_pair(long[q], long[q + LENGTH - 64]) for q in (p0, p1)]
    whole = _pair(_pair(*name), (p1 - p0).astype(np.uint64))
    at = p0 - starts[doc[p0]] << 16 | a[first] - p0 << 8 | p1 - p0 + 1
    return doc[p0], at, short[a[first]].view(np.int64), whole.view(np.int64)


RUNS = "rank long, whole long, doc long, print long, at long"  # at: << 8 | kind
MARKED = "kind byte, doc long, print long, at long"
PARTS = "core long, doc long, print long, start int, bytes binary"
WINDOWS = "kind byte, a long, b long, doc long, print long, at long"
SPLIT = (LENGTH - GRAM) // 2  # windows that begin further before their anchor are the second part


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key that sends rows which need not meet any other evenly to all tasks."""
    return _pair(doc.view(np.uint64), at.astype(np.uint64)).view(np.int64)


def _merge_runs(rank, whole, doc, print_, at) -> pd.DataFrame:
    """Runs of one task: equal ones keep the earliest, the others are repeats; for a rank
    with different runs a token is sent, and its runs go on."""
    order = np.lexsort((at, print_, doc, whole, rank))
    rank, whole, doc, print_, at = (x[order] for x in (rank, whole, doc, print_, at))
    new_rank = np.r_[True, rank[1:] != rank[:-1]]
    new_run = new_rank | np.r_[True, whole[1:] != whole[:-1]]
    group = np.cumsum(new_rank) - 1
    several = np.bincount(group, weights=new_run) > 1
    kind = np.where(new_run, np.where(several[group], GOES_ON, SINGLE), REPEAT)
    tokens = rank[new_rank][several]
    none = np.zeros(len(tokens), dtype=np.int64)
    return pd.DataFrame(
        {
            "rank": np.r_[np.where(kind == SINGLE, rank, _spread(doc, at)), tokens],
            "whole": np.r_[np.where(kind == SINGLE, whole, 0), none],
            "doc": np.r_[doc, none],
            "print": np.r_[print_, none],
            "at": np.r_[at << 8 | kind, none + TOKEN],
        }
    )


def _find_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    rows = 0
    for frame in frames:
        doc, print_ = frame["doc"].to_numpy(), frame["print"].to_numpy()
        for first, texts in _chunks(frame["raw"]):
            which, at, rank, whole = runs_of(texts)
            which = which + first
            held.append((rank, whole, doc[which], print_[which], at))
            rows += len(rank)
        if rows >= HELD_RUNS:
            yield _merge_runs(*(np.concatenate(x) for x in zip(*held)))
            held, rows = [], 0
    if rows:
        yield _merge_runs(*(np.concatenate(x) for x in zip(*held)))


def _chunks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in chunks that fit the processor's cache, with the index of the first."""
    held, size, at = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def _compare_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by rank, whole, document, start -> repeats and runs that go on.

    The ranks at the edges of a batch go on without a look at the next batch: the next round
    decides exactly, so that only costs a few rows.
    """
    for frame in frames:
        kind = frame["at"].to_numpy() & 255
        frame = frame.assign(kind=kind.astype(np.int8), at=frame["at"].to_numpy() >> 8)
        asks = (kind == SINGLE) | (kind == TOKEN)
        yield frame.loc[~asks, ["kind", "doc", "print", "at"]]
        own = frame[asks]
        if not len(own):
            continue
        kind, rank, whole = (own[c].to_numpy() for c in ("kind", "rank", "whole"))
        new_rank = np.r_[True, rank[1:] != rank[:-1]]
        new_run = new_rank | np.r_[True, (whole[1:] != whole[:-1]) | (kind[1:] != kind[:-1])]
        group = np.cumsum(new_rank) - 1
        several = np.bincount(group, weights=new_run) > 1
        several[[0, -1]] = True
        out = np.where(new_run, np.where(several[group], GOES_ON, TOKEN), REPEAT)
        own = own.assign(kind=out.astype(np.int8))
        yield own.loc[(kind == SINGLE) & (out != TOKEN), ["kind", "doc", "print", "at"]]


def _cut_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with their runs that go on -> halves of runs with their bytes, keyed by the
    rank of the bytes all windows of the half have in common (66 or 67 around the anchor)."""
    for frame in frames:
        for first, texts in _chunks(frame["raw"]):
            sizes = np.array([len(t) for t in texts])
            base = np.cumsum(sizes) - sizes
            joined = b"".join(texts)
            _, long = _ranks(np.frombuffer(joined, dtype=np.uint8))
            runs = [np.asarray(r, dtype=np.int64) for r in frame["runs"].iloc[first : first + len(texts)]]
            which = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
            at = np.concatenate(runs)
            p, offset, n = base[which] + (at >> 16), at >> 8 & 255, at & 255
            anchor = p + offset
            middle = anchor - SPLIT  # first window of the near half
            for far in (True, False):
                start = p if far else np.maximum(p, middle)
                end = np.minimum(p + n, middle) if far else p + n
                some = np.flatnonzero(start < end)
                a = anchor[some] - (SPLIT + 1 if far else 0)
                core = _pair(long[a], long[a + (LENGTH - 64 - SPLIT + 1 if far else LENGTH - 64 - SPLIT)])
                rows = which[some] + first
                yield pd.DataFrame(
                    {
                        "core": (core ^ np.uint64(far)).view(np.int64),
                        "doc": frame["doc"].to_numpy()[rows],
                        "print": frame["print"].to_numpy()[rows],
                        "start": (start[some] - base[which[some]]).astype(np.int32),
                        "bytes": [joined[i : j + LENGTH - 1] for i, j in zip(start[some], end[some])],
                    }
                )


def _compare_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Halves sorted by core, document, start -> repeated windows, and the first windows of
    cores at the edges of a batch, which are compared once more."""
    for frame in frames:
        sizes = frame["bytes"].map(len).to_numpy()
        if not len(sizes):
            continue
        base = np.cumsum(sizes) - sizes
        _, long = _ranks(np.frombuffer(b"".join(frame["bytes"]), dtype=np.uint8))
        n = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(sizes)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        q = base[row] + inside
        a, b = long[q], long[q + LENGTH - 64]
        order = np.argsort(_pair(a, b), kind="stable")  # rows come in order of document and start
        repeat = np.zeros(len(row), dtype=bool)
        repeat[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        core = frame["core"].to_numpy()
        edge = (core == core[0]) | (core == core[-1])
        start = frame["start"].to_numpy()[row] + inside
        # neighbouring repeats of one half travel as one run
        t = np.flatnonzero(repeat)
        new = np.r_[True, (np.diff(t) != 1) | (row[t[1:]] != row[t[:-1]])][: len(t)]
        heads = np.flatnonzero(new)
        lengths = np.diff(np.r_[heads, len(t)])
        asks = np.flatnonzero(edge[row] & ~repeat)
        pick = np.r_[t[heads], asks]
        doc, print_ = frame["doc"].to_numpy()[row[pick]], frame["print"].to_numpy()[row[pick]]
        kind = np.r_[np.full(len(heads), REPEAT), np.full(len(asks), SINGLE)]
        at = start[pick].astype(np.int64) << 16 | np.r_[lengths, np.ones(len(asks), dtype=np.int64)]
        yield pd.DataFrame(
            {
                "kind": kind.astype(np.int8),
                "a": np.where(kind == REPEAT, _spread(doc, at), a[pick].view(np.int64)),
                "b": np.where(kind == REPEAT, 0, b[pick].view(np.int64)),
                "doc": doc,
                "print": print_,
                "at": at,
            }
        )


def _compare_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows sorted by rank pair, document, start -> all that are not the first of a pair."""
    last = None
    for frame in frames:
        asks = frame["kind"] == SINGLE
        yield frame.loc[~asks, ["doc", "print", "at"]]
        own = frame[asks]
        if not len(own):
            continue
        a, b = own["a"].to_numpy(), own["b"].to_numpy()
        repeat = np.r_[(a[0], b[0]) == last, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        last = (a[-1], b[-1])
        yield own.loc[repeat, ["doc", "print", "at"]]


def repeated_spans(rows: DataFrame) -> DataFrame:
    """For unique ``doc, print, raw``: the repeated windows of every document as a list of
    ``first window << 16 | ... | number of windows``."""
    key = ["doc", "print"]
    runs = F.collect_list("at").alias("runs")
    first = saved(
        rows.mapInPandas(_find_runs, RUNS)
        .repartition("rank")
        .sortWithinPartitions("rank", "whole", *key, "at")
        .mapInPandas(_compare_runs, MARKED),
        "runs",
    )
    going = first.where(F.col("kind") == GOES_ON).groupBy(*key).agg(runs)
    parts = rows.join(going, key).select(*key, "raw", "runs").mapInPandas(_cut_runs, PARTS)
    second = (
        # by ranges, so that a core with very many rows is cut; its windows meet once more
        parts.repartitionByRange("core", *key, "start")
        .sortWithinPartitions("core", *key, "start")
        .select("core", *key, "start", "bytes")
        .mapInPandas(_compare_parts, WINDOWS)
        .repartition("a")
        .sortWithinPartitions("a", "b", "kind", *key, "at")
        .mapInPandas(_compare_windows, "doc long, print long, at long")
    )
    repeats = first.where(F.col("kind") == REPEAT).drop("kind").unionByName(second)
    return repeats.groupBy(*key).agg(runs)


def _cut(raw: bytes, runs) -> tuple[bytes, int]:
    """The bytes outside all repeated windows, and the number of removed stretches."""
    if runs is None or not len(runs):
        return raw, 0
    packed = np.asarray(runs, dtype=np.int64)
    start, n = packed >> 16, packed & 255
    edges = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + n - 1 + LENGTH, -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), spans


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, raw, n_bytes, n_spans``: kept bytes, bytes before, removed stretches; one row
    per row of ``docs``.

    Null text: empty, nothing removed.  Null doc_id: before all others.  Rows that share a
    doc_id are separate documents in the order of a print of their text; if they share the
    text too they are one document, reported for each row.  Empty table: no rows.  Other
    columns are not read.
    """
    rows, shared = keyed(docs, text, doc_id)
    rows = rows.select("doc", "print", F.col("text").cast("binary").alias("raw"))
    spans = repeated_spans(rows.dropDuplicates(["doc", "print"]) if shared else rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [_cut(raw, runs) for raw, runs in zip(frame["raw"], frame["runs"])]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc"].astype("Int64").mask(frame["doc"] == NO_ID),
                    "raw": [k[0] for k in kept],
                    "n_bytes": frame["raw"].map(len).astype("int64"),
                    "n_spans": np.array([k[1] for k in kept], dtype=np.int64),
                }
            )

    return (
        rows.join(spans, ["doc", "print"], "left")
        .select("doc", "raw", "runs")
        .mapInPandas(run, "doc_id long, raw binary, n_bytes long, n_spans long")
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated strings cut out of the text; n_chars follows if there is one.

    Columns, nulls and keys as in ``remove_repeats``.  A cut may run through a character; what
    is left of one is dropped.
    """
    rows, shared = keyed(docs, text, doc_id)
    doc_, of, out, changed = unused(docs, "doc", "print", "runs", "new")
    spans = repeated_spans(
        (rows.dropDuplicates(["doc", "print"]) if shared else rows).select(
            "doc", "print", F.col("text").cast("binary").alias("raw")
        )
    ).select(F.col("doc").alias(doc_), F.col("print").alias(of), F.col("runs").alias(out))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cut(t.encode(), r)[0].decode("utf-8", "ignore") for t, r in zip(texts, runs)], dtype=object)

    own = F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID))
    print_ = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    # print is 0 for ids that rows do not share
    match = (own == F.col(doc_)) & ((F.col(of) == 0) | (F.col(of) == print_))
    marked = docs.join(spans, match, "left")
    # only texts with something to cut go through Python
    new = F.when(F.col(out).isNull(), docs[text]).otherwise(cut(F.coalesce(docs[text], F.lit("")), F.col(out)))
    kept = marked.withColumn(changed, new)
    columns = [
        F.col(changed).alias(c) if c == text
        else F.length(changed).cast("long").alias(c) if c == "n_chars"
        else docs[c]
        for c in docs.columns
    ]
    return kept.select(*columns)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("raw")).cast("long").alias("n_removed"),
        "n_spans",
        F.sha2("raw", 256).alias("kept_sha256"),
    )
