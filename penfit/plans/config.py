"""Fit configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

STRATEGIES = ("auto", "gradient", "fused", "gram")
LAYOUTS = ("dense", "cells", "sparse")
ORDERS = ("safe", "reference")


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit.

    Defaults of the accelerated method: tol 1e-4, 100 iterations, L0 1,
    Lexact infinite, beta 0.5, alpha 0.9, restart on. ``average`` divides the
    loss by the row count (mean form); the default sum form on raw data equals
    the mean form on rows scaled by sqrt(n).

    strategy: ``gradient`` = loss and gradient at y and at x (two full passes
    per inner step); ``fused`` (default) = the residual form, one pass and one
    gradient per inner step; ``gram`` = one pass for A^T A, then no scans;
    ``auto`` = gram when p <= gram_max_p, else fused.
    loss: None = squared error; another loss of the predictions (see
    penfit.functions.loss) takes ``gradient`` or ``fused``.
    linear_map: None = the design's matrix; a user's map of its rows
    (see penfit.operators.maps) takes ``gradient`` or ``fused``.
    layout: ``dense`` rows, ``cells`` (SQL only) or ``sparse`` (packed sparse rows made
    from cells); ``columns`` is the number of columns of cells, None = largest + 1.
    backtrack_order: ``safe`` decides whether the cheap Lipschitz estimate is
    trustworthy before using it; ``reference`` uses it first, then decides.
    """

    # The defaults of the reference's accelerated method and
    # gradient descent (iterations 100, tolerance 1e-4, L0 1, Lexact infinite,
    # beta 0.5, alpha 0.9, restart on, backtracking tolerance 1e-10, step 0.1).
    max_iter: int = 100
    tol: float = 1e-4
    L0: float = 1.0
    Lexact: float = float("inf")
    beta: float = 0.5
    alpha: float = 0.9
    restart: bool = True
    backtrack_tol: float = 1e-10
    step_size: float = 0.1
    # Own settings.
    convergence_test: bool = True
    backtrack_order: str = "safe"
    average: bool = False
    loss: object = None
    linear_map: object = None
    strategy: str = "fused"
    layout: str = "dense"
    columns: int | None = None
    gram_max_p: int = 1024
    track_history: bool = True
    persist: bool = True
    # write the blockified design to spark.checkpoint.dir (DataFrame.checkpoint)
    # before caching it: lost blocks are re-read from there instead of
    # recomputing a long source lineage (joins, generators)
    checkpoint: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {LAYOUTS}")
        if self.backtrack_order not in ORDERS:
            raise ValueError(f"backtrack_order must be one of {ORDERS}")
        if self.max_iter < 0:
            raise ValueError("max_iter must be >= 0")
        if self.loss is not None and (self.strategy == "gram" or self.layout == "cells"):
            raise ValueError("a loss other than squared error needs strategy 'gradient' or 'fused' "
                             "and the dense or sparse layout")
        if self.linear_map is not None and (self.strategy == "gram" or self.layout != "dense"):
            raise ValueError("a linear map needs strategy 'gradient' or 'fused' and the dense layout")
        if not (self.L0 > 0 and 0 < self.alpha and 0 < self.beta):
            raise ValueError("L0, alpha and beta must be positive")

    def with_(self, **kw) -> "FitConfig":
        return replace(self, **kw)


# Settings of the published benchmark runs: 30 iterations, no convergence
# test, L0 10 (the residual form fixes it; the gradient form is passed it).
BENCHMARK = FitConfig(max_iter=30, L0=10.0, convergence_test=False)
