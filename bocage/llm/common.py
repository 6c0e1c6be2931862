"""What the operators share: tables in the shared folder, local and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after it was counted and has at most so many rows.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder takes its place only where the setting is absent, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="bocage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small; df should be saved."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes that ``df`` has none of them."""
    taken, before = {c.lower() for c in df.columns}, "_"
    while any(before + n in taken for n in names):
        before += "_"
    return [before + n for n in names]


NO_ID = -(1 << 63)  # stands for a null doc_id: before all others


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, bool]:
    """``doc, print, text`` per row, null text as empty; and whether rows share a doc_id.

    print is 0, or names the text where rows share a doc_id, so that (doc, print) is a key
    but for rows that are equal in both.
    """
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    shared = saved(rows.groupBy("doc").count().where("count > 1").select("doc"), "shared-ids")
    if shared.isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("print"), "text"), False
    marked = rows.join(small(shared.withColumn("shared", F.lit(True))), "doc", "left")
    print_ = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return marked.select("doc", print_.alias("print"), "text"), True


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links ``u - v``: every node that is not the smallest of its
    component, and that smallest node."""
    if not len(u):
        return u[:0], u[:0]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            break
        np.minimum.at(root, high[live], low[live])
        while (further := root[root]).tolist() != root.tolist():
            root = further
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the links ``a - b`` (longs): one row ``node, root`` per node,
    ``root`` the smallest node of its component.

    Distributed union-find.  Each round hooks a node's root under the smallest root next to
    it and then follows roots of roots.  Every round is written to the shared folder; both
    sides of each join are plain tables, so that a node with very many links can be split.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = saved(pairs.union(pairs.select("near", "node")).distinct(), "links")
    roots = saved(
        both.groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("root")
        ),
        "roots",
    )
    while True:
        seen = both.join(roots.select(F.col("node").alias("near"), "root"), "near").select("node", "root")
        # a node and the present root of a node both learn the smallest root in sight
        hooks = saved(seen.groupBy("node").agg(F.min("root").alias("low")), "hooks")
        told = (
            roots.join(hooks, "node")
            .where("low < root")
            .select(F.explode(F.array("node", "root")).alias("node"), "low")
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        hooked = saved(
            roots.join(told, "node", "left").select("node", F.least("root", "low").alias("root")), "hooked"
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = saved(hooked.join(up, "root").select("node", F.col("top").alias("root")), "roots")
        changed = after.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old")
        if changed.isEmpty():
            return after
        roots = after
