"""The trie of all conversation prefixes, with totals of its subtrees.

A node of depth d is a distinct sequence of the first d turns; its members are the conversations
that begin so.  Sequences are named, not stored: every turn is a pseudo-random number of its role,
text and place, and a prefix is the sum of its turns, in two lanes of 60 bits.  Sums can be
worked out in pieces, so a conversation with a third of all turns is spread over many tasks.

Rollup by centroid decomposition of the parent-edge forest.  Each round splits every component
at its centroid, the deepest node with more than half of the component's weight below it.  The
weight of a node is its number of members, so that the weight of its subtree is known from a plain
aggregation: the turns that its members have from there on.  What hangs below the centroid falls
into components of at most half the weight, one per child; the rest stays one with less than half.
The values of the split-off part are summed and added along the path from the centroid to the
top of its component: these are exactly the nodes with more than half of the weight, so no link
is followed.  Rounds number log2(turns) however deep a path is.  Components of at most ``LOCAL``
turns are finished by the same recursion in numpy, many in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small
from .places import ranked, runs_before

LOCAL = 20_000  # turns of a component that is finished in one task
LANE = (1 << 60) - 1
SHARED = 9  # a conversation takes fewer turns than this from the first of its five
FIVE = 5


# --- names of prefixes ----------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well stirred; sums wrap."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def turn_numbers(digest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A pseudo-random number per turn from 64 bits of its digest and its place."""
    return _mixed(_mixed(digest) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _add(a: str, b: str) -> str:
    return f"({a} + {b}) & {LANE}"


def named_prefixes(turns: DataFrame) -> DataFrame:
    """``conv, place, digest (32 hex digits), n_bytes, n_turns`` with the names of the prefix that ends with
    the turn (``a, b``) and of the one before (``pa, pb``)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(parts, "conv", "place").sortWithinPartitions("conv", "place")
    dealt = dealt.select("conv", "place", "digest", "n_bytes", "n_turns", F.spark_partition_id().alias("_part"))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry, row = None, np.zeros(2, np.uint64), 0
        for frame in frames:
            if frame.empty:
                continue
            conv, place = frame["conv"].to_numpy(), frame["place"].to_numpy()
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            raw = np.frombuffer(bytes.fromhex("".join(frame["digest"])), ">u8").astype(np.uint64).reshape(-1, 2)
            out = {"conv": conv, "place": place}
            for lane, (this, before) in enumerate((("a", "pa"), ("b", "pb"))):
                number = turn_numbers(raw[:, lane], place)
                total = np.cumsum(number, dtype=np.uint64)
                base = (total - number)[begin] - np.where(new[begin], np.uint64(0), carry[lane])
                ends = total - base
                out[this], out[before] = (ends & LANE).astype(np.int64), ((ends - number) & LANE).astype(np.int64)
                carry[lane] = ends[-1]
            last = conv[-1]
            out |= {"n_bytes": frame["n_bytes"], "n_turns": frame["n_turns"], "_part": frame["_part"], "_i": row + np.arange(len(conv))}
            row += len(conv)
            yield pd.DataFrame(out)

    schema = "conv long, place long, a long, pa long, b long, pb long, n_bytes long, n_turns long, _part int, _i long"
    held = saved(dealt.mapInPandas(add_up, schema), "prefix-sums").withColumn("_g", F.col("conv"))

    def wrapped(column):
        """Sums of lanes, exact however many partitions a conversation has."""
        def one(lane):
            return (F.sum(F.col(f"_last.total.{lane}").cast("decimal(20,0)")).over(column) % (LANE + 1)).cast("long")

        return F.struct(one("a").alias("a"), one("b").alias("b"))

    class _Sum:
        """Both lanes of the rows before, as ``runs_before`` adds them up."""

        def __init__(self, _):
            pass

        def over(self, window):
            return wrapped(window)

    before = runs_before(held, F.struct("a", "b"), _Sum).select(
        "_part", "_g", F.col("_before.a").alias("_a"), F.col("_before.b").alias("_b")
    )
    zero = "coalesce({}, 0L)".format
    return held.join(F.broadcast(before), ["_part", "_g"], "left").selectExpr(
        "conv", "place + 1 AS depth", "n_bytes", "n_turns",
        f"{_add('a', zero('_a'))} AS a", f"{_add('b', zero('_b'))} AS b",
        f"{_add('pa', zero('_a'))} AS pa", f"{_add('pb', zero('_b'))} AS pb",
    )


# --- conversations --------------------------------------------------------------------------------


def rebuilt(turns: DataFrame, shared: int = SHARED, five: int = FIVE) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their ``five``.

    ``conv, place, digest, n_bytes, n_turns`` per turn and ``conv, n_turns`` per conversation; conversation c takes
    the first crc32(c) % ``shared`` turns of c - c % ``five`` and its own turns after as many.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    named = rows.select(
        "conv", "turn", F.octet_length("text").cast("long").alias("n_bytes"),
        F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32).alias("digest"),
    )
    placed = saved(ranked(saved(named, "turns"), ["conv"], ["turn", "digest"], "at"), "placed")
    own = saved(placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    first = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = own.withColumns({"base": F.col("conv") - F.col("conv") % five, "skip": taken}).join(first, "base", "left").selectExpr(
        "conv", "base", "skip", "least(skip, coalesce(n_base, 0L)) AS head",
        "least(skip, coalesce(n_base, 0L)) + greatest(n - skip, 0L) AS n_turns",
    )
    plan = saved(plan, "plan")
    heads = (
        placed.where(f"conv % {five} = 0 AND at < {shared}")
        .withColumnRenamed("conv", "base")
        .join(plan, "base")
        .where("at < head")
        .selectExpr("conv", "at AS place", "digest", "n_bytes", "n_turns")
    )
    tails = placed.join(plan, "conv").where("at >= skip").selectExpr(
        "conv", "head + at - skip AS place", "digest", "n_bytes", "n_turns"
    )
    return saved(heads.union(tails), "rebuilt"), plan.select("conv", "n_turns")


# --- rollup ---------------------------------------------------------------------------------------

_KEPT = ["a", "b", "pa", "pb", "depth", "conv", "weight", "leaf", "saved", "ta", "tb", "more_leaf", "more_saved"]


def rolled_up(nodes: DataFrame, ancestors: DataFrame, local: int = LOCAL) -> DataFrame:
    """``a, b, n_leaves, saved_tokens``: sums of ``leaf`` and ``saved`` over the subtree of every node.

    ``nodes``: ``a, b, pa, pb`` (own and parent's name), ``depth, conv`` (any member), ``weight`` (turns its members
    have from here on), ``leaf, saved``.  ``ancestors``: ``conv, depth, a, b, pa, pb``, the node of every
    conversation and depth.
    """
    live = saved(nodes.select(
        "*", F.lit(0).cast("long").alias("ta"), F.lit(0).cast("long").alias("tb"),
        F.lit(0).cast("long").alias("more_leaf"), F.lit(0).cast("long").alias("more_saved"),
    ).select(*_KEPT), "components")
    done, ready = [], []
    while True:
        tops = live.where("a = ta AND b = tb").select("ta", "tb", F.col("weight").alias("total"))
        large = saved(tops.where(F.col("total") > local), "large")
        if large.isEmpty():
            ready.append(live)
            break
        part = live.join(small(large, 100_000), ["ta", "tb"], "left").select(*_KEPT, "total")
        centre = saved(
            part.where("2 * weight > total").groupBy("ta", "tb").agg(
                F.max_by(F.struct("a", "b", "depth", "weight"), "depth").alias("c")
            ).select("ta", "tb", F.col("c.a").alias("ca"), F.col("c.b").alias("cb"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")),
            "centroids",
        )
        aimed = part.where("total IS NOT NULL").join(small(centre, 100_000), ["ta", "tb"])
        # the ancestor one below the centroid's depth tells whether and where a node hangs below it
        above = ancestors.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("pa").alias("xpa"), F.col("pb").alias("xpb"))
        seen = saved(
            aimed.withColumns({"_conv": F.col("conv"), "_depth": F.expr("if(depth > c_depth, c_depth + 1, -1)")})
            .join(above, ["_conv", "_depth"], "left")
            .selectExpr(
                *_KEPT, "total", "ca", "cb", "c_weight", "a = ca AND b = cb AS centre",
                "coalesce(xpa = ca AND xpb = cb, false) AS below", "xa", "xb",
            ),
            "split",
        )
        sums = saved(
            seen.where("centre OR below").groupBy("ca", "cb").agg(F.sum("leaf").alias("s_leaf"), F.sum("saved").alias("s_saved")),
            "totals",
        )
        told = seen.join(small(sums, 100_000), ["ca", "cb"])
        done.append(told.where("centre").selectExpr("a", "b", "s_leaf + more_leaf AS n_leaves", "s_saved + more_saved AS saved_tokens"))
        path = "NOT below AND 2 * weight > total"
        rest = told.where("NOT centre").selectExpr(
            "a", "b", "pa", "pb", "depth", "conv", f"if({path}, weight - c_weight, weight) AS weight", "leaf", "saved",
            "if(below, xa, ta) AS ta", "if(below, xb, tb) AS tb",
            f"if({path}, more_leaf + s_leaf, more_leaf) AS more_leaf", f"if({path}, more_saved + s_saved, more_saved) AS more_saved",
        )
        ready.append(saved(part.where("total IS NULL").select(*_KEPT), "ready"))
        live = saved(rest, "components")
    every = reduce(DataFrame.unionByName, ready)
    dealt = every.repartition("ta", "tb").sortWithinPartitions("ta", "tb")
    found = dealt.select(*_KEPT).mapInPandas(_finished, "a long, b long, n_leaves long, saved_tokens long")
    return reduce(DataFrame.unionByName, [found, *done])


def _finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole components at a time; the last of a batch may go on in the next."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        ta, tb = frame["ta"].to_numpy(), frame["tb"].to_numpy()
        last = (ta == ta[-1]) & (tb == tb[-1]) if len(ta) else np.zeros(0, bool)
        held = frame[last]
        if not last.all():
            yield local_rollup(frame[~last])
    if held is not None and len(held):
        yield local_rollup(held)


def local_rollup(frame: pd.DataFrame) -> pd.DataFrame:
    """The same recursion over components that are whole in memory."""
    n = len(frame)
    names = pd.MultiIndex.from_arrays([frame["a"], frame["b"]])
    parent = names.get_indexer(pd.MultiIndex.from_arrays([frame["pa"], frame["pb"]]))
    is_top = ((frame["a"] == frame["ta"]) & (frame["b"] == frame["tb"])).to_numpy()
    parent = np.where(is_top, -1, parent)
    depth, weight = frame["depth"].to_numpy(), frame["weight"].to_numpy().copy()
    values = frame[["leaf", "saved"]].to_numpy()
    more = frame[["more_leaf", "more_saved"]].to_numpy().copy()
    live = np.ones(n, bool)
    while live.any():
        at = np.flatnonzero(live)
        held_by = parent[at]
        up = np.where((held_by >= 0) & live[held_by], held_by, at)
        top = np.arange(n)
        top[at] = up
        while (further := top[top])[at].tolist() != top[at].tolist():
            top = further
        own = top[at]
        sums = np.zeros((n, 2), np.int64)
        np.add.at(sums, own, values[at])  # per component, by its top
        heavy = at[2 * weight[at] > weight[own]]
        deepest = heavy[np.lexsort((depth[heavy], top[heavy]))]
        ends = np.concatenate([top[deepest][1:] != top[deepest][:-1], [True]])
        centre = deepest[ends]  # one per component
        centre_of = np.full(n, -1)
        centre_of[top[centre]] = centre
        # what hangs below the centroid: its component without it, by the children
        live[centre] = False
        left = np.flatnonzero(live)
        held_by = parent[left]
        again = np.arange(n)
        again[left] = np.where((held_by >= 0) & live[held_by], held_by, left)
        while (further := again[again])[left].tolist() != again[left].tolist():
            again = further
        totals = np.zeros((n, 2), np.int64)
        np.add.at(totals, centre, values[centre])
        below = left[(parent[again[left]] >= 0) & ~live[parent[again[left]]]]
        below = below[parent[again[below]] == centre_of[top[below]]]
        np.add.at(totals, centre_of[top[below]], values[below])
        path = heavy[live[heavy]]
        more[path] += totals[centre_of[top[path]]]
        weight[path] -= weight[centre_of[top[path]]]
        more[centre] += totals[centre]
    out = frame[["a", "b"]].reset_index(drop=True)
    return out.assign(n_leaves=more[:, 0], saved_tokens=more[:, 1])


# --- ends -----------------------------------------------------------------------------------------


def _ends_hashes(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ascending, comma-joined ``conv`` of each node.

    Ids are sorted by ranges and joined to texts where they lie, at most one row per node and task; the texts of a
    node are then hashed as a stream, so its ids are never held together.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ends = ends.repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    pieces = (
        sorted_ends.withColumn("_part", F.spark_partition_id())
        .mapInPandas(_joined, "a long, b long, part int, n long, ids string")
    )
    streams = saved(pieces, "ends").repartition("a", "b").sortWithinPartitions("a", "b", "part", "n")
    return streams.mapInPandas(_hashed, "a long, b long, ends_sha256 string")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = 0
    for frame in frames:
        if frame.empty:
            continue
        a, b, conv = (frame[c].to_numpy() for c in ("a", "b", "conv"))
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        texts = list(map(str, conv.tolist()))
        ids = [",".join(texts[i:j]) for i, j in zip(begin, [*begin[1:], len(conv)])]
        yield pd.DataFrame({"a": a[begin], "b": b[begin], "part": frame["_part"].iloc[0], "n": n + np.arange(len(begin)), "ids": ids})
        n += len(begin)


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for frame in frames:
        out = []
        for a, b, ids in zip(frame["a"], frame["b"], frame["ids"]):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (a, b), sha256(ids.encode())
        yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"]).astype({"a": "int64", "b": "int64"})
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends_sha256"])


# --- operator -------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, shared: int = SHARED, five: int = FIVE, local: int = LOCAL) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    Turns are ordered by ``turn`` (null first), those that share one by the SHA-256 of role and text; repeated rows
    are turns of their own.  Null role or text: empty.  Rows without conv_id belong to no conversation and are left out.
    Without any conversation there is no node.  Further columns are not read.
    """
    sequences, convs = rebuilt(turns, shared, five)
    steps = saved(named_prefixes(sequences), "prefixes")
    zero = F.lit(0).cast("long")
    root = convs.agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n_turns") + 1).alias("weight"),
    ).where("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), F.lit(-1).cast("long").alias("pa"), F.lit(-1).cast("long").alias("pb"), zero.alias("depth"),
        "conv", "n_convs", "weight", zero.alias("n_bytes"),
    )
    nodes = steps.groupBy("a", "b").agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.expr("n_turns - depth + 1")).alias("weight"), F.first("n_bytes").alias("n_bytes"),
    )
    nodes = saved(nodes.unionByName(root), "nodes")
    children = nodes.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    full = saved(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    rolled = rolled_up(
        full.select("a", "b", "pa", "pb", "depth", "conv", "weight", F.expr("if(n_children = 0, 1L, 0L)").alias("leaf"), F.expr("(n_convs - 1) * n_bytes").alias("saved")),
        steps.select("conv", "depth", "a", "b", "pa", "pb"),
        local,
    )
    ends = steps.where("depth = n_turns").select("a", "b", "conv").union(
        convs.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv")
    )
    parents = saved(full.select("pa", "pb", F.col("conv").alias("kid"), F.col("a").alias("ka"), F.col("b").alias("kb")).join(
        full.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id")), ["pa", "pb"]
    ).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "parent_conv_id"), "parents")
    return (
        full.join(saved(rolled, "rolled"), ["a", "b"])
        .join(saved(_ends_hashes(ends), "ends-hashed"), ["a", "b"], "left")
        .join(parents, ["a", "b"], "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# Prefixes are spelt out as lists of turn digests here.
_BIT = "lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))"
OP11_SQL = f"""WITH own AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
    strlen(coalesce(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
  turns AS (SELECT c, h, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, h) - 1 AS i FROM own),
  convs AS (SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(split(CAST(c AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {_BIT})), 4294967295::UBIGINT) % {SHARED} AS skip FROM turns),
  mixed AS (SELECT v.c, 0 AS part, i, h, bytes FROM convs v JOIN turns t ON t.c = v.c - v.c % {FIVE} AND i < skip
    UNION ALL SELECT v.c, 1, i, h, bytes FROM convs v JOIN turns t ON t.c = v.c AND i >= skip),
  seq AS (SELECT c, row_number() OVER w AS depth, bytes, string_agg(h, '') OVER w AS name FROM mixed WINDOW w AS (PARTITION BY c ORDER BY part, i)),
  steps AS MATERIALIZED (SELECT c, depth, name, bytes FROM seq UNION ALL SELECT c, 0, '', 0 FROM convs),
  lens AS (SELECT c, max(depth) AS n FROM steps GROUP BY c),
  nodes AS MATERIALIZED (SELECT depth, name, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN depth = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM steps JOIN lens USING (c) GROUP BY depth, name),
  kids AS (SELECT depth - 1 AS depth, name[:64 * (depth - 1)] AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
  full_ AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, name)),
  rolled AS (SELECT s.depth, s.name, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
    FROM full_ f JOIN steps s ON s.c = f.conv_id AND s.depth <= f.depth GROUP BY s.depth, s.name)
  SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
  FROM full_ f JOIN rolled USING (depth, name) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.name = f.name[:64 * (f.depth - 1)] AND f.depth > 0"""
