"""Objectives: what a partition is worth, as column expressions and as numbers for kernels.

An objective is a bilinear form: a community is worth ``unit`` times its inner weight, less half the square of each of
its masses times that mass' price. A mass is a sum of a vertex column (node_size, strength, or for signed objectives
above and below, the strengths by edges of positive and of negative weight); prices may depend on the graph's totals.
All phases (moving in rounds or blocks, refinement, quality) take the form from here, so that an objective of one's own
is a subclass with `masses` and `prices`.

Communities are rows (c, n_members, internal_w, x0, x1, ...), a column for each mass. A candidate move of a vertex has
the columns w_src, w_tgt (weight to both communities without self-loops) and for each mass x0 (the vertex'), src_x0,
tgt_x0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Totals:
    """Summed weights of a graph's edges (self-loops once), of all, of the positive and of the negative (as a positive
    number), and summed vertex sizes."""

    weight: float
    size: float = 0.0
    above: float = 0.0
    below: float = 0.0


def totals(m: Totals | float) -> Totals:
    """m, or the totals of a graph of that weight when an objective needs no others."""
    return m if isinstance(m, Totals) else Totals(m, above=m)


class Objective:
    """A bilinear form; subclasses say what the masses and their prices are."""

    #: Whether masses take the columns above and below.
    signed: bool = False

    def masses(self) -> tuple[Column, ...]:
        """Masses of a vertex, from the vertex columns."""
        raise NotImplementedError

    def prices(self, m: Totals | float) -> tuple[float, ...]:
        """The price of each mass in a graph of these totals."""
        raise NotImplementedError

    def unit(self, m: Totals | float) -> float:
        """What a unit of weight within a community is worth."""
        return 1.0

    def linear(self, m: Totals | float) -> tuple[float, ...]:
        """What a unit of each mass is worth, whatever the partition."""
        return (0.0,) * len(self.prices(m))

    def quality(self, m: Totals | float) -> Column:
        """Aggregate over communities."""
        worth = self.unit(m) * F.col("internal_w")
        for k, (p, a) in enumerate(zip(self.prices(m), self.linear(m), strict=True)):
            worth = worth - p * F.col(f"x{k}") * F.col(f"x{k}") / 2 + a * F.col(f"x{k}")
        return F.coalesce(F.sum(worth), F.lit(0.0))

    def delta(self, m: Totals | float) -> Column:
        """Change of quality by a candidate move."""
        gain = self.unit(m) * (F.col("w_tgt") - F.col("w_src"))
        for k, p in enumerate(self.prices(m)):
            x = F.col(f"x{k}")
            gain = gain - p * x * (F.col(f"tgt_x{k}") - (F.col(f"src_x{k}") - x))
        return gain

    def mass(self) -> Column:
        """The first mass of a vertex."""
        return self.masses()[0]

    def resolution(self, m: Totals | float) -> float:
        """Weight that refinement asks for each unit of the product of first masses."""
        return self.prices(m)[0] / self.unit(m) if self.unit(m) else 0.0


def _checked(gamma: float) -> None:
    if not gamma > 0 or gamma == float("inf"):
        raise ValueError("the resolution must be finite and positive")


@dataclass(frozen=True)
class ConstantPotts(Objective):
    """Internal weight less gamma for each pair of vertices of a community."""

    gamma: float

    def __post_init__(self):
        _checked(self.gamma)

    def masses(self):
        return (F.col("node_size"),)

    def prices(self, m):
        return (self.gamma,)

    def linear(self, m):
        return (self.gamma / 2,)


@dataclass(frozen=True)
class Modularity(Objective):
    """Modularity times twice the total weight; 0 for a graph without weight."""

    gamma: float = 1.0

    def __post_init__(self):
        _checked(self.gamma)

    def unit(self, m):
        return 2.0 if totals(m).weight else 0.0

    def masses(self):
        return (F.col("strength"),)

    def prices(self, m):
        m = totals(m).weight
        return (self.gamma / m if m else 0.0,)


@dataclass(frozen=True)
class ErdosRenyi(Objective):
    """Internal weight less gamma times what a random graph of the same density has within a community."""

    gamma: float = 1.0

    def __post_init__(self):
        _checked(self.gamma)

    def masses(self):
        return (F.col("node_size"),)

    def prices(self, m):
        t = totals(m)
        pairs = t.size * (t.size - 1) / 2
        return (self.gamma * t.weight / pairs if pairs > 0 else 0.0,)

    def linear(self, m):
        return (self.prices(m)[0] / 2,)


@dataclass(frozen=True)
class SignedModularity(Objective):
    """Modularity of the positive edges less that of the negative ones, each times twice its weight.

    Positive edges are wanted within communities and negative ones between them.
    """

    gamma: float = 1.0
    gamma_below: float = 1.0
    signed = True

    def __post_init__(self):
        _checked(self.gamma)
        _checked(self.gamma_below)

    def unit(self, m):
        return 2.0

    def masses(self):
        return (F.col("above"), F.col("below"))

    def prices(self, m):
        t = totals(m)
        return (self.gamma / t.above if t.above else 0.0, -self.gamma_below / t.below if t.below else 0.0)


def normalised(quality: float, m: float) -> float:
    """Modularity proper from its objective value."""
    return quality / (2 * m) if m else 0.0
