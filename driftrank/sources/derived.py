"""Edge streams that come from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.operators.scan import with_position
from driftrank.plans.stream import EdgeStream
from driftrank.storage import kept


def stored(edges: DataFrame, vertices: DataFrame, directed: bool) -> EdgeStream:
    """The stream as a Parquet table in order of ``pos``: a window is a filter that skips row groups."""
    return EdgeStream(kept(edges.select("pos", "src", "dst"), "pos"), kept(vertices.select("id")), directed)


def event_graph(spark: SparkSession, sf_dir: str) -> EdgeStream:
    """Directed: from each event's user to the next event's."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("long").alias("src"))
    numbered = with_position(events, ["event_id"]).select("pos", "src")
    following = numbered.select((F.col("pos") - 1).alias("pos"), F.col("src").alias("dst"))
    edges = numbered.join(following, "pos").select("pos", "src", "dst")
    return stored(edges, events.select(F.col("src").alias("id")).distinct(), directed=True)


def supply_graph(spark: SparkSession, sf_dir: str) -> EdgeStream:
    """Undirected, bipartite: parts and suppliers of line items; supplier ids come after the part ids."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*(F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    shift = parts.agg(F.max("id")).first()[0]
    shift = 0 if shift is None else shift + 1
    numbered = with_position(items, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    edges = numbered.select("pos", F.col("l_partkey").alias("src"), (F.col("l_suppkey") + shift).alias("dst"))
    return stored(edges, parts.unionByName(suppliers.select((F.col("id") + shift).alias("id"))), directed=False)
