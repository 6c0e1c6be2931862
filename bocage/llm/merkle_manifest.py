"""Merkle manifest of a dataset: a digest per document, per source and for all of it, with proofs.

Method.  The documents of a source are the leaves of a tree of threes.  Every ``3**LEVELS``
neighbouring leaves are an aligned subtree, and one row of a Spark table holds it whole, in the
layout of van Emde Boas: a tree of h levels is its upper h//2 levels followed by the subtrees
below them, each laid out alike, so that a walk from a leaf to the root reads few distant places
at any size of memory.  ``addresses`` works out where the node of a depth and index lies; the
subtrees are built through it, and siblings are read back through it.  The roots of the subtrees
are the leaves of the next round, until one is left: about log(n) / 6.6 rounds.

Places of leaves come from a range-partitioned sort, so a source with a third of all documents is
dealt to a third of the tasks and its subtrees to all of them.  No row holds more than one subtree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small
from .places import ranked

ARITY = 3
LEVELS = 6  # edges from a subtree's leaves to its root: 729 leaves, 35 KB
# Paths are broadcast up to so many rows: one is about 128 bytes a level of its tree, 5 KB at 40 levels.
FEW = 10_000

NODES = "key string, block long, size int, height int, nodes binary, root string"
PATH = "lefts array<string>, rights array<string>"


@cache
def addresses(levels: int) -> list[np.ndarray]:
    """For every depth (0: the root) the place of each of its nodes in the layout."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    above = levels // 2
    upper, lower = addresses(above), addresses(levels - above)
    first, each = _nodes(above), _nodes(levels - above)
    begin = first + each * np.arange(ARITY**above)[:, None]
    return [*upper, *[(begin + at).ravel() for at in lower]]


def _nodes(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def laid_out(leaves: list[str], height: int) -> bytes:
    """Digests of the whole subtree over ``leaves``, ``height`` edges high; nodes not there are zero."""
    at, out = addresses(height + 1), np.zeros((_nodes(height + 1), 32), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        out[at[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if depth:
            row = [_hash("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
    return out.tobytes()


def sibling_texts(nodes: bytes, size: int, height: int) -> list[tuple[list[str], list[str]]]:
    """Per level from the leaves up: of every node the joined digests of its siblings to the left and right."""
    at, flat, out = addresses(height + 1), np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
    for depth in range(height, 0, -1):
        text = flat[at[depth][:size]].tobytes().hex()
        row = [text[i : i + 64] for i in range(0, len(text), 64)]
        begin = [i - i % ARITY for i in range(size)]
        out.append((
            ["".join(row[b:i]) for i, b in enumerate(begin)],
            ["".join(row[i + 1 : b + ARITY]) for i, b in enumerate(begin)],
        ))
        size = -(-size // ARITY)
    return out


# --- leaves ---------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


# --- construction ---------------------------------------------------------------------------------


def _members(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    """``key, block, members``: the leaves of each subtree in order, at most ``3**levels``."""
    width = ARITY**levels
    leaves = F.sort_array(F.collect_list(F.struct((F.col("at") % width).alias("i"), *columns)))
    return nodes.groupBy("key", F.expr(f"at div {width}").alias("block")).agg(leaves.alias("members"))


def _subtrees(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per subtree over ``key, at, digest``; a subtree that is all of its tree is no higher than needed."""
    rows = _members(nodes, levels, "digest").select("key", "block", F.col("members.digest").alias("leaves"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, heights, trees, roots = [], [], [], []
            for block, leaves in zip(batch.column("block").to_pylist(), batch.column("leaves").to_pylist()):
                height = 0
                while ARITY**height < len(leaves):
                    height += 1
                height = levels if block else height
                tree = laid_out(leaves, height)
                sizes.append(len(leaves))
                heights.append(height)
                trees.append(tree)
                roots.append(tree[:32].hex())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("block"), pa.array(sizes, pa.int32()), pa.array(heights, pa.int32()),
                 pa.array(trees, pa.binary()), pa.array(roots, pa.string())],
                names=["key", "block", "size", "height", "nodes", "root"],
            )

    return rows.mapInArrow(build, NODES)


def manifest(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of subtrees over ``key, at, digest``: the roots of one are the leaves of the next.

    Columns ``key, block, size, height, nodes, root`` and ``ends``: the subtree's root is that of the whole tree.
    """
    rounds = []
    while True:
        part = saved(_subtrees(nodes, levels), "subtrees")
        # a subtree has neighbours only if it is full or not the first
        part = part.withColumn("ends", (F.col("block") == 0) & (F.col("size") < ARITY**levels))
        rounds.append(part)
        further = part.where("NOT ends")
        if further.isEmpty():
            return rounds
        nodes = further.select("key", F.col("block").alias("at"), F.col("root").alias("digest"))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """``key, top``: the root of every tree."""
    out = None
    for part in rounds:
        own = part.where("ends").select("key", F.col("root").alias("top"))
        out = own if out is None else out.unionByName(own)
    return out


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, so that no more than one subtree is unpacked at a time."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


# --- paths ----------------------------------------------------------------------------------------


def _with_paths(rounds: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """First round's subtrees with the siblings ``lefts, rights`` of their roots, level by level upwards.

    ``ends``: ``key, lefts, rights`` and more columns above each tree's root.
    """
    extra = [c for c in ends.columns if c != "key"]
    below = None
    for part in reversed(rounds):
        done = part.where("ends").join(small(ends, FEW), "key")
        if below is not None:
            above = saved(_leaf_paths(below, extra, levels), "paths").withColumnRenamed("at", "block")
            done = done.unionByName(part.where("NOT ends").join(small(above, FEW), ["key", "block"]).select(*done.columns))
        below = done
    return below


def _leaf_paths(trees: DataFrame, extra: list[str], levels: int) -> DataFrame:
    """``key, at, lefts, rights`` and ``extra`` columns for every leaf of the subtrees."""
    kept = [c for c in extra if c not in ("lefts", "rights")]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            texts, out = sibling_texts(row["nodes"], row["size"], row["height"]), []
            for i in range(row["size"]):
                at = [i // ARITY**j for j in range(len(texts))]
                sides = [[texts[j][side][k] for j, k in enumerate(at)] for side in (0, 1)]
                out.append({
                    "key": row["key"], "at": row["block"] * ARITY**levels + i,
                    "lefts": sides[0] + row["lefts"], "rights": sides[1] + row["rights"],
                } | {c: row[c] for c in kept})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    fields = [("key", pa.string()), ("at", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]
    fields += [(c, pa.string()) for c in kept]
    return trees.mapInArrow(expand, f"key string, at long, {PATH}" + "".join(f", {c} string" for c in kept))


def _paths_of_tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    """``at, lefts, rights, whole`` for the leaves of the one tree that has everything below it."""
    root = tops(rounds).select("key", F.col("top").alias("whole"))
    nothing = F.array().cast("array<string>")
    ends = root.select("key", nothing.alias("lefts"), nothing.alias("rights"), "whole")
    return _leaf_paths(_with_paths(rounds, ends, levels), ["lefts", "rights", "whole"], levels).drop("key")


def verified(
    docs: DataFrame,
    forge: Column | None = None,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    source: str = "source",
    doc_id: str = "doc_id",
    levels: int = LEVELS,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    ``forge``: a text that stands in place of column ``text`` when proofs are checked, null for no change.
    ``folded_root`` is worked out from the leaf as found then and the siblings of the manifest.

    Null doc_ids come first in their source, rows that share one are in the order of their leaves (equal rows share
    leaf and differ in proof only); null and empty sources are two sources; a null field is a dash, an empty one
    ``0:``.  Empty table: no rows.  Further columns are not read.
    """
    own = {c: F.col(c) for c in fields}
    changed = own | {"text": forge} if forge is not None else own
    forged = F.when(forge.isNotNull() & ~forge.eqNullSafe(F.col("text")), _digest(*changed.values())) if forge is not None else F.lit(None)
    rows = docs.select(
        # order of bytes, null before all others
        F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string"))).alias("key"),
        F.col(doc_id).cast("long").alias("doc_id"),
        _digest(*own.values()).alias("digest"),
        forged.cast("string").alias("forged"),
    )
    placed = saved(ranked(rows, ["key"], ["doc_id", "digest"]), "leaves")
    rounds = manifest(placed.select("key", "at", "digest"), levels)
    sources = ranked(tops(rounds), [], ["key"])
    above = manifest(sources.select(F.lit("").alias("key"), "at", F.col("top").alias("digest")), levels)
    paths = _paths_of_tops(above, levels)
    ends = saved(sources.join(small(saved(paths, "top-paths"), FEW), "at").select("key", "lefts", "rights", "whole", F.col("top").alias("subroot")), "ends")
    trees = _with_paths(rounds, ends, levels)
    members = _members(placed, levels, "doc_id", "digest", "forged")
    return trees.join(members, ["key", "block"]).mapInArrow(
        _checked, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for row in _one_by_one(batches):
        texts = sibling_texts(row["nodes"], row["size"], row["height"])
        upper = list(zip(row["lefts"], row["rights"]))
        upper_text = "".join(a + b for a, b in upper)
        out: list[list] = [[] for _ in names]
        for i, member in enumerate(row["members"]):
            now, proof, k = member["forged"] or member["digest"], [], i
            for lefts, rights in texts:
                proof += (lefts[k], rights[k])
                now = _hash(lefts[k] + now + rights[k])
                k //= ARITY
            for left, right in upper:
                now = _hash(left + now + right)
            values = (
                member["doc_id"], member["digest"], row["subroot"], row["whole"],
                _hash("".join(proof) + upper_text), now, now == row["whole"],
            )
            for column, value in zip(out, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n"),
        F.replace("text", F.lit("\n"), F.lit("")),
    )
    return verified(docs, tampered)


# --- the same in SQL ------------------------------------------------------------------------------


def _levels_sql(t: str, levels: int, keys: str) -> str:
    """Levels ``{t}0`` … over ``{t}0(k, i, h, n)`` and the siblings ``{t}p0`` … of their nodes."""
    out = []
    for j in range(levels):
        out.append(f"""{t}p{j} AS MATERIALIZED (SELECT a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
            coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM {t}{j} a JOIN {t}{j} b ON a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.k, a.i)""")
        out.append(f"""{t}{j + 1} AS MATERIALIZED (SELECT k, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 2) // 3 AS n
            FROM {t}{j} WHERE n > 1 GROUP BY k, i // 3, n)""")
    return ", ".join(out)


def op13_sql(levels: int = 11, source_levels: int = 7) -> str:
    """For up to ``3**levels`` documents a source and ``3**source_levels`` sources."""
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(
            f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in fields
        ) + ")"

    bit = "xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))"
    crc = f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {bit})), 4294967295::UBIGINT)"""
    fold, chain = "f0", []
    for j in range(levels):
        chain.append(f"""f{j + 1} AS (SELECT f.* EXCLUDE (cur, proof), CASE WHEN l IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur,
            proof || coalesce(l || r, '') AS proof FROM {fold} f LEFT JOIN tp{j} p ON p.k = f.k AND p.i = f.i // {3**j})""")
        fold = f"f{j + 1}"
    chain.append(f"g0 AS (SELECT f.*, s.i AS si, s.h AS subroot FROM {fold} f JOIN sub s USING (k))")
    fold = "g0"
    for j in range(source_levels):
        chain.append(f"""g{j + 1} AS (SELECT f.* EXCLUDE (cur, proof), CASE WHEN l IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur,
            proof || coalesce(l || r, '') AS proof FROM {fold} f LEFT JOIN sp{j} p ON p.i = f.si // {3**j})""")
        fold = f"g{j + 1}"
    ends = " UNION ALL ".join(f"SELECT k, h FROM t{j} WHERE n = 1" for j in range(levels + 1))
    top = " UNION ALL ".join(f"SELECT h FROM s{j} WHERE n = 1" for j in range(source_levels + 1))
    return f"""WITH leaves AS MATERIALIZED (SELECT doc_id, coalesce('1' || source, '0') AS k, {leaf("text")} AS leaf,
        CASE WHEN ({crc}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS forged FROM documents),
      placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves),
      t0 AS (SELECT k, i, leaf AS h, n FROM placed), {_levels_sql("t", levels, "k")},
      sub AS MATERIALIZED (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i FROM ({ends})),
      s0 AS (SELECT 0 AS k, i, h, (SELECT count(*) FROM sub) AS n FROM sub), {_levels_sql("s", source_levels, "k")},
      top AS ({top}),
      f0 AS (SELECT doc_id, leaf, k, i, coalesce(forged, leaf) AS cur, '' AS proof FROM placed), {", ".join(chain)}
      SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = top.h AS verified FROM {fold}, top"""
