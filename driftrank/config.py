"""Parameters and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

ALPHA = 0.15
EPSILON = 1e-9
WINDOW_RATIO = 0.1


class Variant(Enum):
    """How the next frontier is derived. All of them meet the same error bound.

    ``vanilla``: the vertices that may be pushed. ``fast_frontier``: those that crossed the bound in the last round, from
    what the push left behind. ``optimized``: those that crossed it or still lie beyond it. ``eager``: as vanilla, but a
    round takes one residue class of ids, whose pushes the next class sees.
    """

    OPTIMIZED = "optimized"
    FAST_FRONTIER = "fast_frontier"
    EAGER = "eager"
    VANILLA = "vanilla"


class Phases(Enum):
    """``signed``: positive residuals to their fixpoint, then negative ones. ``merged``: both at once."""

    SIGNED = "signed"
    MERGED = "merged"


@dataclass(frozen=True)
class Slide:
    """Window size, edges in a batch, number of batches."""

    window: int
    size: int
    batches: int

    def __post_init__(self) -> None:
        if self.window < 1 or self.size < 1 or self.batches < 0:
            raise ValueError(f"a window and a batch need an edge at least: {self}")
        if self.size > self.window:
            raise ValueError("a batch larger than the window would delete edges before they come in")

    @property
    def total(self) -> int:
        return self.size * self.batches

    def reported_total(self, n_edges: int) -> int:
        """The total that reports name: no more than the stream has behind the first window."""
        return min(self.total, n_edges - self.window)

    @property
    def report_every(self) -> int:
        """Batches from one progress report to the next: large batches are reported each, small ones by the thousand."""
        return 1 if self.size >= 100 else 1000

    @classmethod
    def by_ratio(cls, n_edges: int, slide_ratio: float, batches: int, window_ratio: float = WINDOW_RATIO) -> Slide:
        """A batch is a share of the window."""
        if not 0 < window_ratio <= 1 or slide_ratio <= 0 or batches < 1:
            raise ValueError("ratios lie in (0, 1] and batches count from 1")
        window = int(n_edges * window_ratio)
        return cls(window, int(window * slide_ratio), batches)

    @classmethod
    def by_size(cls, n_edges: int, size: int, total: int, window_ratio: float = WINDOW_RATIO) -> Slide:
        """Batches of ``size`` edges, as many full ones as cover ``total``."""
        if not 0 < window_ratio <= 1 or size < 1 or total < 1:
            raise ValueError("a batch and the total need an edge at least")
        return cls(int(n_edges * window_ratio), size, -(-total // size))


def check_push(alpha: float, epsilon: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    if epsilon <= 0:
        raise ValueError("epsilon is positive")
