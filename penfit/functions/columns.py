"""Column builders. Everything here is a Catalyst expression, so it runs
JVM-side inside the scan's stage; no Python per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designs wider than this use broadcast variables and Arrow passes instead of
# literal arrays: a literal array is part of every task's serialized plan.
MAX_LITERAL_ARRAY = 4096


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def soft_threshold(v, t) -> Column:
    """L1 proximal map sign(v) * max(|v| - t, 0) (O19). ``+ 0.0`` turns -0.0
    into 0.0 so results compare equal across engines; t = 0 is the identity."""
    v = _col(v)
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0)) + F.lit(0.0)


def combine(a, alpha, b, beta) -> Column:
    """alpha * a + beta * b for two columns of the same row."""
    return F.lit(float(alpha)) * _col(a) + F.lit(float(beta)) * _col(b)


def residual(prediction="prediction", label="label") -> Column:
    """prediction - label, the sign used by the squared-error gradient."""
    return _col(prediction) - _col(label)


def _literal_array(values: Sequence[float]) -> Column:
    if len(values) > MAX_LITERAL_ARRAY:
        raise ValueError(f"{len(values)} coefficients are too many for a literal array; "
                         "use the Arrow form (penfit.operators.passes)")
    return F.array(*[F.lit(float(v)) for v in values])


def array_dot(features, coefficients: Sequence[float]) -> Column:
    """features . coefficients for a narrow design (O16, SQL form)."""
    lit = _literal_array(coefficients)
    return F.aggregate(F.zip_with(_col(features), lit, lambda a, b: a * b),
                       F.lit(0.0), lambda acc, v: acc + v)


def divide_by(features, norms: Sequence[float]) -> Column:
    """Element-wise division by column norms; a zero norm gives 0.0, not NaN
    (O14; the reference's NaN for empty columns is not kept)."""
    lit = _literal_array(norms)
    return F.zip_with(_col(features), lit,
                      lambda a, n: F.when(n != 0.0, a / n).otherwise(F.lit(0.0)))


def array_scale(features, c: float) -> Column:
    """Every element times a constant."""
    return F.transform(_col(features), lambda v: v * F.lit(float(c)))
