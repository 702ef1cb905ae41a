"""Shared-folder tables, connected components and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go at the end of each write, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lets a join on (part, row) use a table bucketed by part alone.
PARTIAL_KEYS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. A folder of this machine is used
    only where that setting is absent and driver and executors are one process, as in local tests.
    """
    global _fallback_dir
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        _fallback_dir = _fallback_dir or tempfile.mkdtemp(prefix="quillon-")
        root = f"file://{_fallback_dir}"
    return f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets the session's ``values`` for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, where: str) -> DataFrame:
    """Write ``df`` as Parquet at ``where`` and read it back.

    The written table cuts the lineage, survives lost executors, and, unlike the output of
    an aggregate, lets adaptive execution split skewed partitions of a join on either side.
    """
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


@contextmanager
def stored_rows(docs: DataFrame, where: str, without: tuple[str, ...] = ()) -> Iterator[tuple[DataFrame, list[str], list[str]]]:
    """``docs`` as a table with numbers ``_row`` and ``_part``, its columns' names, and those they stand for.

    The table is bucketed by scan partition, so it is written without a shuffle, and what is known of a row can join it in place. Its names can't clash with the
    caller's: ``id`` is doc_id, ``text`` is text. It lasts as long as the context.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in without]
    inner = [{"doc_id": "id", "text": "text"}.get(c, f"c{k}") for k, c in enumerate(kept)]
    rows = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(kept, inner, strict=True)])
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    name = f"quillon_rows_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "_part").option("path", f"{where}/rows").option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        yield spark.table(name), inner, kept
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, f"{where}/rows")


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete written tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, where: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as (node, root) with root the smallest node.

    ``edges`` has columns ``u`` and ``v`` of one type that can be ordered. Alternates the large-star and small-star
    steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014), which
    needs a logarithmic number of rounds on chains as well. Each round is written below
    ``where``; minima are partial aggregates and both sides of each join are written tables,
    so a node that holds a third of all edges is split by adaptive execution. Nodes without
    an edge to another node are absent. A round's tables are deleted after the next one.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{where}/e0")
    before = None
    for k in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{where}/l{k}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{where}/a{k}")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{where}/m{k}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{where}/e{k + 1}")
        remove(edges.sparkSession, *[f"{where}/{x}{k}" for x in "lam"], f"{where}/e{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
