"""Fuzzy duplicate lines: MinHash, exact Jaccard check, union-find; one line of each
component stays.

Method.  A line is trimmed of spaces and lowered; lines without a character stay out.
Equal lines are one line to begin with.  The signature of a line is a one-permutation MinHash
of its 8-character shingles in ``BANDS * ROWS`` bins; bins that no shingle falls into borrow
from another bin.  Lines that agree in all rows of a band are candidates: at a similarity of
0.8 a pair is missed with a probability of about (1 - 0.8^4)^10 = 0.5 %, and less above.
Candidates are verified by the exact Jaccard similarity of their shingle sets.  Distributed
union-find over the verified links gives components; of all lines of a component, equal
ones included, the first (by doc_id, then position) stays.

Scale.  Per distinct line and task 10 rows of 16 bytes are shuffled.  A band value that many
lines of one task share is reduced there: beyond ``FEW`` lines each is a candidate with some
before it, and only the first ``FEW`` are sent on.  The same holds where the rows meet, so
candidates grow with the lines, never with the square of a group, and a group streams
through a task in bounded memory.  Texts are shuffled only for lines that are candidates.

Crowded band values.  Lines of a value with more than ``FEW`` lines are written down.  Where the
links found so far leave such a value in one component, more links could not change it.  The
lines of all other crowded values go through an exact join: in one order of all shingles, lines
with a similarity of t share one of their first 1 + size - ceil(t * size), so lines of different
components that share one, with sizes and places that allow t, are candidates too.  So no link is
lost to ``FEW``.  The order puts rare shingles first, by counts of a fixed number of hash buckets.

Shingles.  An ASCII shingle is its 8 bytes, any other a 63-bit hash; similarities are exact but for
collisions of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, saved, small, unused

SHINGLE = 8
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
SIMILARITY = 0.8
FEW = 8  # up to so many lines of a band value, all pairs are candidates; more make it crowded
BACK = 4  # beyond, those with the first and the last so many lines
CHUNK = 1 << 16  # characters hashed at once
BUCKETS = 1 << 18  # hash buckets of shingles, the bound of what is sent to the driver and back
SEED = 42

_TOP = np.uint64(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _lenders(j: int) -> list[int]:
    """All bins in the order in which bin ``j`` would borrow from them."""
    order: dict[int, None] = {}
    step = 0
    while len(order) < BINS:
        step += 1
        order.setdefault(xxhash.xxh32_intdigest(bytes([j, step & 255, step >> 8])) % BINS)
    return list(order)


LENDERS = np.array([_lenders(j) for j in range(BINS)])


def _mix(a: np.ndarray, b) -> np.ndarray:
    x = a * _M1 + b
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def lines_of(rows: DataFrame) -> DataFrame:
    """``doc, print, line_no, line, id`` of keyed rows; id is a 64-bit hash of the normal line."""
    split = rows.select("doc", "print", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line", normal(F.col("line"))).where("line <> ''").withColumn("id", F.xxhash64("line"))


def windows(text: str) -> np.ndarray:
    """A number for each 8-character shingle of a text of 8 characters or more, in order.

    An ASCII shingle is its 8 bytes, below 2^63; any other is a hash of 63 bits above that.
    """
    if text.isascii():
        raw = text.encode()
        return np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, 0, (1,)).copy()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(points) - SHINGLE + 1
    found = np.ndarray(n, "<u8", points.astype(np.uint8).tobytes(), 0, (1,)).copy()
    beyond = np.r_[0, np.cumsum(points > 127)]
    other = np.flatnonzero(beyond[SHINGLE:] != beyond[:n])
    h = np.zeros(len(other), dtype=np.uint64)
    for i in range(SHINGLE):
        h = h * _M1 + points[other + i]
        h ^= h >> np.uint64(29)
    found[other] = _mix(h, np.uint64(0)) | _TOP
    return found


def _chunks(lines: list[str]) -> Iterator[list[str]]:
    """The lines, some ``CHUNK`` characters at a time."""
    ends = np.cumsum([len(x) for x in lines])
    at = 0
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
        yield lines[at:end]
        at = end


def _all_windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of all lines, one line after the other, and how many each has; short ones are filled up."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]  # so that it has one shingle
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    found = windows("".join(lines))
    inside = np.ones(len(found), dtype=bool)  # shingles that end in their own line
    for i in range(1, SHINGLE):
        inside[ends[:-1] - i] = False
    return found[inside], sizes - SHINGLE + 1


def all_shingle_ids(lines: list[str]) -> Iterator[np.ndarray]:
    """Per line its distinct shingles, sorted; a line shorter than a shingle is its own."""
    for some in _chunks(lines):
        found, counts = _all_windows(some)
        ends = np.cumsum(counts)
        for line, end, n in zip(some, ends.tolist(), counts.tolist()):
            if len(line) < SHINGLE:
                found[end - 1] = np.uint64(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))) | _TOP
            elif n > 1:
                found[end - n : end].sort()
        new = np.ones(len(found), dtype=bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        new[ends - counts] = True
        stops = np.cumsum(new)[ends - 1].tolist()
        found, at = found[new], 0
        for stop in stops:
            yield found[at:stop]
            at = stop


def shingle_ids(line: str) -> np.ndarray:
    return next(all_shingle_ids([line]))


def shingles(line: str) -> frozenset:
    return frozenset(shingle_ids(line).tolist())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two lines share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def band_keys(lines: list[str]) -> np.ndarray:
    """Keys of the bands, one row per line."""
    found, counts = _all_windows(lines)
    rank = _mix(found, np.uint64(SEED))
    slot = ((rank >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).view(np.int64)
    slot += np.repeat(np.arange(len(lines)) * BINS, counts)
    none = ~np.uint64(0)
    bins = np.full(len(lines) * BINS, none)
    np.minimum.at(bins, slot, rank)
    bins = bins.reshape(len(lines), BINS)
    filled, own = bins.copy(), bins != none
    for j in range(BINS):
        empty = np.flatnonzero(~own[:, j])
        if len(empty):
            filled[empty, j] = bins[empty, LENDERS[j][own[empty][:, LENDERS[j]].argmax(axis=1)]]
    keys = np.zeros((len(lines), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), np.uint64(band))
        for r in range(ROWS):
            key = _mix(filled[:, band * ROWS + r], key)
        keys[:, band] = key
    return keys.view(np.int64)


def _candidates(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows sorted by key, and the place of every row among those of its key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    a, b = [], []
    for back in range(1, FEW):
        later = np.flatnonzero(place >= back if back <= BACK else (place >= back) & (place < FEW))
        a.append(later)
        b.append(later - back)
    far = np.flatnonzero(place >= FEW)
    for first in range(BACK):
        a.append(far)
        b.append(far - place[far] + first)
    a, b = line[np.concatenate(a)], line[np.concatenate(b)]
    return np.minimum(a, b), np.maximum(a, b), place


WORDS = 8  # longs of parities: 512 bits
BAND, PAIR, MEMBER = 0, 1, 2  # kinds of rows: (key, id), (id, id), (crowded key, id)


def _rows(kind: int, first: np.ndarray, second: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": first, "b": second, "kind": np.full(len(first), kind, dtype=np.int8)})


def _crowded(key: np.ndarray) -> np.ndarray:
    """Which of the sorted keys occur more than ``FEW`` times."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    return np.repeat(sizes > FEW, sizes)


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines -> band rows and, of values crowded in the batch, candidates and members."""
    for frame in frames:
        frame = frame.drop_duplicates("id")
        ids, lines = frame["id"].to_numpy(), frame["line"].tolist()
        keys = [band_keys(some) for some in _chunks(lines)]
        key, line = np.concatenate(keys).ravel(), np.repeat(ids, BANDS)
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        a, b, place = _candidates(key, line)
        sent = place < FEW
        pair = np.unique(np.stack([a, b]), axis=1)
        many = _crowded(key)
        yield pd.concat(
            [_rows(BAND, key[sent], line[sent]), _rows(PAIR, *pair), _rows(MEMBER, key[many], line[many])]
        )


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Band rows sorted by key -> candidates, and members of crowded keys; other rows as they are."""
    held = None  # of the last key: its first lines, and the last ones
    for frame in frames:
        band = frame["kind"].to_numpy() == BAND
        yield frame[~band]
        key, line = frame["a"].to_numpy()[band], frame["b"].to_numpy()[band]
        if not len(key):
            continue
        if held is not None and held[0] == key[0]:
            key, line = np.r_[np.full(len(held[1]), held[0]), key], np.r_[held[1], line]
        new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
        key, line = key[new], line[new]
        a, b, _ = _candidates(key, line)
        many = _crowded(key)
        yield pd.concat([_rows(PAIR, a, b), _rows(MEMBER, key[many], line[many])])
        own = line[key == key[-1]]
        held = (key[-1], own if len(own) <= 2 * FEW else np.r_[own[:FEW], own[-FEW:]])


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``a < b`` of line ids that agree in a band, and the members ``key, id`` of
    crowded band values."""
    schema = "a long, b long, kind byte"
    rows = lines.select("id", "line").mapInPandas(_signed, schema)
    # rows of a band value meet; what is a candidate already is dealt over all tasks
    second = F.when(F.col("kind") == BAND, F.lit(0).cast("long")).otherwise(F.col("b"))
    dealt = rows.repartition(F.col("a"), second).sortWithinPartitions("a", "b")
    met = saved(dealt.mapInPandas(_met, schema), "met")
    pairs = met.where((F.col("kind") == PAIR) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    members = met.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id")).distinct()
    return pairs, members


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (_mix(tokens, np.uint64(SEED)) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of the lines fall into each of the ``BUCKETS`` hash buckets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for frame in frames:
            for tokens in all_shingle_ids(frame["line"].tolist()):
                np.add.at(n, _bucket(tokens), 1)
        bucket = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": bucket, "n": n[bucket]})

    found = texts.select("line").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def parities(tokens: np.ndarray) -> np.ndarray:
    """``8 * WORDS`` bytes as longs: for each bit whether an odd number of the shingles hash to it.

    The bits in which two lines differ come from shingles that only one of them has, each from
    another one: lines differ in at least as many shingles as bits.
    """
    bit = (_mix(tokens, np.uint64(SEED + 1)) % np.uint64(64 * WORDS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def rare_shingles(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, root, size, place, token`` and ``parities`` ``p0, p1`` … of ``id, root, line``: of every line the first
    shingles in one order of all shingles, so many that lines with the similarity share one.

    Shingles of thinly filled buckets come first.  Any fixed order is exact; this one keeps
    shingles that very many lines have out of the way.  A shingle alone in its bucket is in
    no other line: it takes up a place and is left out.
    """
    counts = bucket_counts(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 50):  # shingles of few lines at a time
                some, held, odd = frame.iloc[at : at + 50], [], []
                for row, tokens in enumerate(all_shingle_ids(some["line"].tolist())):
                    size = len(tokens)
                    n = counts[_bucket(tokens)]
                    first = np.lexsort((tokens, n))[: size - math.ceil(size * similarity - 1e-9) + 1]
                    place = np.flatnonzero(n[first] > 1)
                    odd.append(parities(tokens))
                    held.append((np.full(len(place), row), np.full(len(place), size), place, tokens[first[place]].view(np.int64)))
                row, size, place, token = (np.concatenate(x) for x in zip(*held))
                own = {c: some[c].to_numpy()[row] for c in ("id", "root")}
                bits = {f"p{i}": column[row] for i, column in enumerate(np.stack(odd, 1))}
                yield pd.DataFrame(own | {"size": size, "place": place, "token": token} | bits)

    schema = "id long, root long, size long, place long, token long" + "".join(f", p{i} long" for i in range(WORDS))
    return texts.select("id", "root", "line").mapInPandas(run, schema)


def crowded_candidates(texts: DataFrame, members: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a < b`` that may link different components inside crowded band values.

    Exact: every pair of such lines with at least ``similarity`` is among them.  Lines that share a
    shingle are compared by their parities inside the join, which leaves few that are not alike.
    """
    placed = members.join(small(roots), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    placed = saved(placed, "members")
    spread = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    spread = saved(spread.select("key"), "spread")
    open_ = saved(placed.join(small(spread), "key", "left_semi").select("id", "root").distinct(), "open-lines")
    rare = saved(rare_shingles(texts.join(small(open_), "id"), similarity), "rare-shingles")
    x, y = rare.alias("x"), rare.alias("y")
    share = similarity / (1 + similarity)
    differ = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(WORDS))
    most = F.least(F.expr("x.size - x.place"), F.expr("y.size - y.place"))  # can be shared from here on
    return (
        x.join(
            y,
            F.expr("x.token = y.token AND x.id < y.id AND x.root <> y.root")
            & (most >= (F.expr("x.size + y.size")) * share - 1e-9)
            & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-9)
            & (F.expr(differ) <= F.expr("x.size + y.size") * ((1 - similarity) / (1 + similarity)) + 1e-9),
        )
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose lines have an exact Jaccard similarity of at least ``similarity``; texts
    has ``id, line``, once per id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, mine = None, np.zeros(0, dtype=np.uint64)
        for frame in frames:
            keep = []
            every = all_shingle_ids(frame["line"].tolist())
            for a, b, other in zip(frame["a"].tolist(), frame["b"].tolist(), every):
                if a == b:
                    own, mine = a, other
                    keep.append(False)
                    continue
                # the smaller set bounds what both can share
                low, high = sorted((len(mine), len(other)))
                both = shared(mine, other) if own == a and low >= similarity * high else 0
                keep.append(own == a and both >= similarity * (low + high - both))
            yield frame.loc[keep, ["a", "b"]]

    ends = pairs.union(pairs.select("a", F.col("a").alias("b")).distinct())
    # every line `a` comes first, then the lines it is compared with, one at a time
    return (
        ends.join(texts.withColumnRenamed("id", "b"), "b")
        .select("a", "b", "line", (F.col("a") != F.col("b")).alias("other"))
        .repartition("a")
        .sortWithinPartitions("a", "other")
        .mapInPandas(run, "a long, b long")
    )


def joined_by(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` after further links: only the roots that these touch are united anew."""
    top = roots.withColumnRenamed("id", "end").withColumnRenamed("root", "top")
    for end in ("a", "b"):
        links = links.join(top.withColumnRenamed("end", end), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    moved = components(links, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    # a line without links so far is its own root
    every = roots.unionByName(moved.join(roots, "root", "left_anti").select(F.col("root").alias("id"), "root"))
    return saved(every.join(moved, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "joined")


def removed_lines(rows: DataFrame) -> DataFrame:
    """For unique keyed rows: ``doc, print, gone``, the numbers of the lines that go."""
    lines = lines_of(rows)
    pairs, members = candidates(lines)
    pairs = saved(pairs, "candidates")
    wanted = pairs.select("a").union(pairs.select("b")).union(members.select("id")).toDF("id").distinct()
    texts = lines.select("id", "line").join(small(saved(wanted, "candidate-lines")), "id", "left_semi")
    texts = saved(texts.distinct(), "texts")  # the id names the line
    links = saved(verified(pairs, texts), "links")
    roots = components(links, "a", "b").withColumnRenamed("node", "id")
    further = saved(crowded_candidates(texts, members, roots).join(pairs, ["a", "b"], "left_anti"), "further")
    found = saved(verified(further, texts), "further-links")
    if not found.isEmpty():
        roots = joined_by(roots, found)
    places = saved(lines.select("doc", "print", "line_no", "id"), "places").join(small(roots), "id", "left")
    places = places.select(F.coalesce("root", "id").alias("root"), F.struct("doc", "print", "line_no").alias("place"))
    many = places.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    many = saved(places.join(small(saved(many, "repeated")), "root", "left_semi"), "repeats")
    firsts = many.groupBy("root").agg(F.min("place").alias("first"))
    gone = many.join(saved(firsts, "firsts"), "root").where("place <> first")
    return gone.groupBy("place.doc", "place.print").agg(F.array_sort(F.collect_list("place.line_no")).alias("gone"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, gone``: number of lines, and the numbers (from 0) of those that go.

    Null or empty text: one empty line, which stays.  Null doc_id: before all others.  Rows
    that share a doc_id are separate documents in the order of a print of their text; if
    they share the text too they are one document, reported for each row.  Blank
    lines stay.  Lines shorter than a shingle go only with equal ones.  Empty table: no rows.
    Other columns are not read.
    """
    rows, shared = keyed(docs, text, doc_id)
    gone = removed_lines(rows.dropDuplicates(["doc", "print"]) if shared else rows)
    counts = rows.select("doc", "print", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counts.join(gone, ["doc", "print"], "left").select(
        F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "n_lines", F.coalesce("gone", none).alias("gone")
    )


def without_removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the lines taken out of the text; n_chars follows if there is one."""
    rows, shared = keyed(docs, text, doc_id)
    gone = removed_lines(rows.dropDuplicates(["doc", "print"]) if shared else rows)
    print_ = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) if shared else F.lit(0).cast("long")
    # print is 0 again for ids that are not shared
    doc_, of, out, changed = unused(docs, "doc", "print", "gone", "new")
    gone = gone.select(F.col("doc").alias(doc_), F.col("print").alias(of), F.col("gone").alias(out))
    own = F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63)))
    match = (own == F.col(doc_)) & ((F.col(of) == 0) | (F.col(of) == print_))
    left = F.filter(F.split(docs[text], "\n"), lambda x, i: ~F.array_contains(out, i))
    new = F.when(F.col(out).isNull(), docs[text]).otherwise(F.array_join(left, "\n"))
    kept = docs.join(gone, match, "left").withColumn(changed, new)
    columns = [
        F.col(changed).alias(c) if c == text
        else F.length(changed).cast("long").alias(c) if c == "n_chars"
        else docs[c]
        for c in docs.columns
    ]
    return kept.select(*columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
