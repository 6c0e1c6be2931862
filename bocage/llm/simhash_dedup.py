"""Near-duplicate documents: SimHash fingerprints linked through a covering code.

Method (anchor-point covering).  The 64 bits are cut into ``PARTS`` parts; two fingerprints
that differ in at most ``threshold`` bits differ in at most ``threshold // PARTS`` bits of
some part.  In a part, the anchors are the code words of a covering code of radius 1: the
Hamming code of length 15 on the low bits, every pattern on the others.  A fingerprint is
*at home* at its nearest anchor and *visits* every anchor within radius + the part's
threshold.  Any linked pair therefore meets at the home anchor of either one, and only
fingerprints of the same anchor are compared.  The search is exact.

Scale.  Equal fingerprints are merged before anything is replicated.  A fingerprint makes
about 45 rows.  An anchor with more than ``CELL_ROWS`` rows is cut into cells (home slice x
visitor slice), so a task holds at most a few thousand rows of an anchor at a time; the
number of anchors is fixed by the code (3 x 2^18 at most), which bounds the table of crowded
ones.  An anchor gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, saved, small, unused

PARTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
CODE_BITS = 15  # length of the Hamming code
CELL_ROWS = 4096
PAIRS_AT_ONCE = 2_000_000


def fingerprint(raw: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit number; no word gives 0."""
    words = raw.lower().split() if raw else []  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(text, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[i:j], seed) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes)).view("<u8")[0])


def fingerprints(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, seed: int = 42
) -> DataFrame:
    """One row ``doc_id, fp`` (signed 64-bit) per document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = np.array([fingerprint(t, shingle, seed) for t in frame["raw"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": made.view(np.int64)})

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw")
    )
    return rows.mapInPandas(run, "doc_id long, fp long")


@cache
def _flips(width: int, radius: int) -> list[np.ndarray]:
    """For every syndrome, the bit flips of at most ``radius`` bits that lead to a code word."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for n in range(radius + 1):
        for bits in combinations(range(width), n):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < CODE_BITS else 0
            found[syndrome].append(sum(1 << b for b in bits))
    return [np.array(x, dtype=np.int64) for x in found]


def _syndromes(part: np.ndarray) -> np.ndarray:
    out = np.zeros(len(part), dtype=np.int64)
    for b in range(CODE_BITS):
        out ^= ((part >> b) & 1) * (b + 1)
    return out


def anchored(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Rows ``anchor, home, fp, node``: each fingerprint at its home and at all it visits."""
    reach = 1 + threshold // len(PARTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp, node = frame["fp"].to_numpy(), frame["node"].to_numpy()
            for k, (first, width) in enumerate(PARTS):
                part = (fp >> first) & ((1 << width) - 1)
                syndrome = _syndromes(part)
                for s in range(CODE_BITS + 1):
                    rows = np.flatnonzero(syndrome == s)
                    for home, radius in ((True, 1), (False, reach)):
                        flips = _flips(width, radius)[s][: 1 if home else None]
                        anchor = (part[rows][:, None] ^ flips[None, :]).ravel() | (k << 40)
                        at = np.repeat(rows, len(flips))
                        yield pd.DataFrame(
                            {"anchor": anchor, "home": home, "fp": fp[at], "node": node[at]}
                        )

    return fps.select("fp", "node").mapInPandas(run, "anchor long, home boolean, fp long, node long")


def _cell_links(cell, home, fp, node, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole cells, rows sorted by cell with homes first."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    homes = np.add.reduceat(home.astype(np.int64), starts)
    visits = sizes - homes
    h = np.flatnonzero(home)
    group = np.repeat(np.arange(len(starts)), homes)  # of each home row
    us, vs = [], []
    many = np.cumsum(visits[group])
    cut = 0
    while cut < len(h):
        done = many[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(many, done + PAIRS_AT_ONCE)))
        g = group[cut:end]
        n = visits[g]
        left = np.repeat(h[cut:end], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[g] + homes[g], n)
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= threshold
        u, v = local_roots(node[left[near]], node[right[near]])
        us.append(u)
        vs.append(v)
        cut = end
    if not us:
        return node[:0], node[:0]
    return local_roots(np.concatenate(us), np.concatenate(vs))


def near_links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Links ``u, v`` that span the same components as all pairs within ``threshold`` bits."""
    rows = anchored(fps, threshold)
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = F.broadcast(
        counts.where(F.col("n") > CELL_ROWS).select(
            "anchor", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("slices")
        )
    )
    slice_of = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    cells = (
        rows.join(crowded, "anchor", "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("other", F.explode(every))
        .withColumn(
            "cell",
            F.when(F.col("home"), slice_of * F.col("slices") + F.col("other")).otherwise(
                F.col("other") * F.col("slices") + slice_of
            ),
        )
        .select(F.xxhash64("anchor", "cell").alias("cell"), "home", "fp", "node")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            last = frame["cell"].iloc[-1]
            whole = frame[frame["cell"] != last]
            if len(whole) or held and held[-1]["cell"].iloc[-1] != last:
                ready = pd.concat([*held, whole])
                yield links_of(ready)
                held = []
            held.append(frame[frame["cell"] == last])
        if held:
            yield links_of(pd.concat(held))

    def links_of(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = _cell_links(*(frame[c].to_numpy() for c in ("cell", "home", "fp", "node")), threshold)
        return pd.DataFrame({"u": u, "v": v})

    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", F.desc("home"))
    return sorted_cells.mapInPandas(run, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: int = 4,
    shingle: int = 4,
    seed: int = 42,
) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links.

    Null or blank text: fingerprint 0, linked like any other.  Rows with a null doc_id get a
    fingerprint and the component of that fingerprint, but name no component.  Rows that
    share a doc_id count as one document and join their components.  An empty table gives no
    rows; other columns are not read.
    """
    own = saved(fingerprints(docs, text, doc_id, shingle, seed), "fingerprints")
    firsts = saved(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    links = saved(near_links(firsts.where("node IS NOT NULL"), threshold), "near")
    roots = components(links.where("u <> v"), "u", "v")
    classes = saved(
        firsts.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")),
        "components",
    )
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose doc_id names their component, and rows without a doc_id; columns
    as they came.  Rows that share a doc_id stay or go together."""
    groups = near_duplicates(docs, **options)
    (kept,) = unused(docs, "kept_id")
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    marked = docs.join(small(saved(keep, "keep")), docs["doc_id"] == F.col(kept), "left")
    return marked.where(F.col(kept).isNotNull() | F.col("doc_id").isNull()).select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
