"""Edges that arrive as files, in batches of exactly k, whatever the micro-batches.

``foreachBatch`` appends each chunk to a buffer table, then runs as many full slides as the buffer holds without a gap, in
whatever order the files come.
The state of a slide is written under its number, so a replayed micro-batch overwrites its chunk and
skips slides that are committed; results do not depend on where micro-batches begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftrank.config import ALPHA, EPSILON, Slide
from driftrank.functions import transition_weight
from driftrank.operators.degree import out_degrees
from driftrank.operators.edges import mirror, multiplicities
from driftrank.plans.engine import target_frame
from driftrank.plans.push import init_state, push
from driftrank.plans.repair import repair
from driftrank.plans.stream import EdgeStream

EDGE_SCHEMA = "pos bigint, src bigint, dst bigint"
STATE_SCHEMA = "target bigint, id bigint, p double, r double"


class SlidingPPR:
    """Keeps ``root/edges/chunk=*`` and ``root/state/batch=*``; ``root`` lies in storage that all executors see."""

    def __init__(self, vertices: DataFrame, targets, slide: Slide, root: str, directed: bool = True, epsilon: float = EPSILON, alpha: float = ALPHA, strategy: str = "bsp"):
        self.vertices, self.slide, self.root, self.directed = vertices, slide, root.rstrip("/"), directed
        self.targets, self.epsilon, self.alpha, self.strategy = target_frame(vertices, targets), epsilon, alpha, strategy
        self.spark: SparkSession = vertices.sparkSession

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def state(self, batch: int) -> DataFrame:
        """The state after so many slides; 0 is the first full window."""
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/state/batch={batch}")

    def done(self) -> int:
        """The last slide committed, -1 before the first window is full."""
        n = -1
        while self._exists(f"{self.root}/state/batch={n + 1}/_SUCCESS"):
            n += 1
        return n

    def _weights(self, pairs: DataFrame) -> DataFrame:
        m = multiplicities(pairs)
        degree = m.groupBy("src").agg(F.sum("m").alias("d"))
        return m.join(degree, "src").select("src", "dst", "m", transition_weight(F.col("m"), F.col("d"), self.alpha).alias("w"))

    @staticmethod
    def _dense(edges: DataFrame, start: int) -> int:
        """The first position from ``start`` on that has not arrived: chunks may come in any order, and a window waits for all its edges."""
        pos = edges.where(F.col("pos") >= start).select("pos")
        after = pos.select((F.col("pos") + 1).alias("pos")).unionByName(edges.sparkSession.range(start, start + 1).select(F.col("id").alias("pos")))
        return after.join(pos, "pos", "left_anti").agg(F.min("pos")).first()[0]

    def process(self, chunk: DataFrame, chunk_id: int) -> None:
        chunk.select("pos", "src", "dst").write.mode("overwrite").parquet(f"{self.root}/edges/chunk={chunk_id}")
        edges = self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.root}/edges/chunk=*")
        stream = EdgeStream(edges, self.vertices, self.directed)
        batch = self.done() + 1
        held = self._dense(edges, max(0, self.slide.size * (batch - 1)))
        while self.slide.window + self.slide.size * batch <= held:
            pairs = stream.window_pairs(self.slide, batch)
            if batch == 0:
                start, warm = init_state(self.vertices, self.targets), False
            else:
                before = out_degrees(stream.window_pairs(self.slide, batch - 1), self.vertices)
                updates = stream.edges.where(self._moved(batch)).withColumn("sign", F.when(F.col("pos") < self.slide.size * batch, -1).otherwise(1))
                updates = updates if self.directed else mirror(updates)
                start, warm = repair(self.state(batch - 1), updates, before, self.alpha), True
            state, _ = push(start, self._weights(pairs), self.epsilon, self.alpha, strategy=self.strategy, warm=warm)
            state.write.mode("overwrite").parquet(f"{self.root}/state/batch={batch}")
            batch += 1

    def _moved(self, batch: int):
        low, k, w = self.slide.size * (batch - 1), self.slide.size, self.slide.window
        pos = F.col("pos")
        return ((pos >= low) & (pos < low + k)) | ((pos >= low + w) & (pos < low + w + k))

    def start(self, source: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow a folder of Parquet files ``(pos, src, dst)``; ``pos`` is dense over all of them."""
        edges = self.spark.readStream.schema(EDGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        writer = edges.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_degrees(edges: DataFrame, slide: Slide) -> DataFrame:
    """``(batch, id, d)`` by Spark's own hopping windows over ``pos`` as seconds; of a table full windows only.

    The end of a stream is not known: its last windows come out as far as they are filled.
    """
    at = F.window(F.timestamp_seconds("pos"), f"{slide.window} seconds", f"{slide.size} seconds")
    counted = edges.groupBy(at.alias("w"), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    start = F.unix_timestamp("w.start")
    full = counted.where(start >= 0)
    if not edges.isStreaming:
        held = edges.agg((F.max("pos") + 1).alias("held"))
        full = full.join(F.broadcast(held), start + slide.window <= F.col("held"))
    # Spark aligns windows to multiples of the slide from 0, so start / size is the batch.
    return full.select((start / slide.size).cast("long").alias("batch"), "id", "d")
