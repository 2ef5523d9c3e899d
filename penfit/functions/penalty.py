"""Penalty plug-ins (O43): value(w) and prox(v, t) over the coefficient
vector, which lives on the driver (length p, never n)."""

from __future__ import annotations

import numpy as np


def soft_threshold_np(v: np.ndarray, s: float) -> np.ndarray:
    """sign(v) * max(|v| - s, 0); identity for s = 0; 0 stays 0."""
    if s == 0.0:
        return v.copy()
    return np.sign(v) * np.maximum(np.abs(v) - s, 0.0) + 0.0


class L1Penalty:
    """h(w) = lam * ||w||_1; prox with step t is soft thresholding by lam*t."""

    name = "l1"

    def __init__(self, lam: float):
        if not np.isfinite(lam) or lam < 0:
            raise ValueError(f"penalty level must be finite and >= 0, got {lam}")
        self.lam = float(lam)

    def value(self, w: np.ndarray) -> float:
        return self.lam * float(np.abs(w).sum())

    def prox(self, v: np.ndarray, t: float) -> np.ndarray:
        return soft_threshold_np(v, self.lam * t)


class NoPenalty:
    """h = 0; prox is the identity."""

    name = "none"
    lam = 0.0

    def value(self, w: np.ndarray) -> float:
        return 0.0

    def prox(self, v: np.ndarray, t: float) -> np.ndarray:
        return v.copy()


def make_penalty(lam_or_penalty):
    """A penalty: any object with ``value(w)`` and ``prox(v, t)`` as it is, a
    number as the level of an L1 penalty, None as no penalty."""
    if lam_or_penalty is None:
        return NoPenalty()
    if callable(getattr(lam_or_penalty, "value", None)) and callable(getattr(lam_or_penalty, "prox", None)):
        return lam_or_penalty
    return L1Penalty(float(lam_or_penalty))
