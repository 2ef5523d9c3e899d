"""Column expressions and the loss / penalty plug-ins."""

from penfit.functions.columns import (array_dot, array_scale, combine, divide_by, residual,
                                      soft_threshold)
from penfit.functions.loss import SquaredError
from penfit.functions.penalty import L1Penalty, NoPenalty, make_penalty, soft_threshold_np

__all__ = ["array_dot", "array_scale", "combine", "divide_by", "residual", "soft_threshold",
           "SquaredError", "L1Penalty", "NoPenalty", "make_penalty", "soft_threshold_np"]
