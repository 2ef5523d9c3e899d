"""Smooth loss plug-ins (O42). The reference ships squared error only. A plug-in
gives value and derivative of the loss as a function of the residual
r = prediction - label (``value_np``, ``derivative_np``) or, if it is not a function of
the residual alone, of predictions and labels (``value_rows``, ``derivative_rows``), in
NumPy for the Arrow tasks; and as column expressions of the residual for the SQL
forms, if there is one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class SquaredError:
    """f(r) = r^2 / 2 summed over rows; f'(r) = r."""

    name = "squared_error"

    @staticmethod
    def value_np(r: np.ndarray) -> float:
        return 0.5 * float(r @ r)

    @staticmethod
    def derivative_np(r: np.ndarray) -> np.ndarray:
        return r

    @staticmethod
    def value_col(r: Column) -> Column:
        return r * r / F.lit(2.0)

    @staticmethod
    def derivative_col(r: Column) -> Column:
        return r


class Huber:
    """r^2 / 2 up to ``delta``, delta (|r| - delta / 2) beyond, summed over rows."""

    name = "huber"

    def __init__(self, delta: float = 1.0):
        if not delta > 0:
            raise ValueError("delta must be positive")
        self.delta = float(delta)

    def value_np(self, r: np.ndarray) -> float:
        a = np.abs(r)
        return float(np.where(a <= self.delta, 0.5 * r * r, self.delta * (a - 0.5 * self.delta)).sum())

    def derivative_np(self, r: np.ndarray) -> np.ndarray:
        return np.clip(r, -self.delta, self.delta)

    def value_col(self, r: Column) -> Column:
        d = F.lit(self.delta)
        return F.when(F.abs(r) <= d, r * r / F.lit(2.0)).otherwise(d * (F.abs(r) - d / F.lit(2.0)))

    def derivative_col(self, r: Column) -> Column:
        return F.greatest(F.least(r, F.lit(self.delta)), F.lit(-self.delta))


class Logistic:
    """log(1 + exp(-s a)) with s = 1 for labels above 0 and -1 for others, summed over rows."""

    name = "logistic"

    @staticmethod
    def value_rows(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.logaddexp(0.0, np.where(b > 0, -a, a)).sum())

    @staticmethod
    def derivative_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.where(b > 0, 1.0, -1.0)
        return -s * np.exp(-np.logaddexp(0.0, s * a))
