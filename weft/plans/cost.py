"""Constants of the cost models."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Weights:
    """Interleaved plans: scale and weights of scanning, expanding, checking an edge and joining. Fixed values."""

    scale: float = 0.1
    scan: float = 1.0
    expand: float = 1.0
    check: float = 0.1
    join: float = 1.0


@dataclass(frozen=True)
class PatternWeights:
    """Pattern plans: instances + adjacency x alpha + intersected x beta, and both sides of a join x w1. Fixed values."""

    alpha: float = 0.15
    beta: float = 0.1
    w1: float = 6.0
