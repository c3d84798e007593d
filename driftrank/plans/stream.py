"""Edge streams and their count-based sliding windows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.config import Slide
from driftrank.functions import transition_weight
from driftrank.operators.edges import mirror, multiplicities
from driftrank.operators.degree import out_degrees


class EdgeStream:
    """``edges(pos, src, dst)`` in order of arrival, and ``vertices(id)``, those without edges included.

    A window is a range of positions, so it is a pushed-down filter on the stored stream and does not
    depend on how batches line up with it.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame, directed: bool):
        self.edges, self.vertices, self.directed = edges, vertices, directed

    @cached_property
    def n_edges(self) -> int:
        return self.edges.count()

    def _span(self, start: int, stop: int) -> DataFrame:
        return self.edges.where((F.col("pos") >= start) & (F.col("pos") < stop))

    def window(self, slide: Slide, batch: int = 0) -> DataFrame:
        """The edges in the window after ``batch`` slides, as they arrived."""
        return self._span(slide.size * batch, slide.size * batch + slide.window)

    def window_pairs(self, slide: Slide, batch: int = 0) -> DataFrame:
        """The same as directed pairs: both directions if the stream is undirected."""
        edges = self.window(slide, batch).select("src", "dst")
        return edges if self.directed else mirror(edges)

    def is_over(self, slide: Slide, batch: int) -> bool:
        """Whether fewer than a full batch remains; the rest of a stream is never taken."""
        return slide.size * (batch + 1) + slide.window > self.n_edges

    def updates(self, slide: Slide, batch: int) -> DataFrame:
        """``(pos, src, dst, sign)``: the oldest edges go (-1), as many new ones come (+1)."""
        if self.is_over(slide, batch):
            raise StopIteration(f"the stream ends before batch {batch} is full")
        start = slide.size * batch
        old = self._span(start, start + slide.size).withColumn("sign", F.lit(-1))
        new = self._span(start + slide.window, start + slide.window + slide.size).withColumn("sign", F.lit(1))
        both = old.unionByName(new)
        return both if self.directed else mirror(both).select("pos", "src", "dst", "sign")

    def degrees(self, slide: Slide, batch: int = 0) -> DataFrame:
        return out_degrees(self.window_pairs(slide, batch), self.vertices)

    def weights(self, slide: Slide, batch: int, alpha: float) -> DataFrame:
        """``(src, dst, m, w)``: parallel edges in one, with the share of a residual at dst that src gets."""
        pairs = multiplicities(self.window_pairs(slide, batch))
        degree = pairs.groupBy("src").agg(F.sum("m").alias("d"))
        return pairs.join(degree, "src").select("src", "dst", "m", transition_weight(F.col("m"), F.col("d"), alpha).alias("w"))
