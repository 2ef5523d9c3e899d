"""NumPy oracles that share no code path with the fits: cyclic coordinate
descent for the solution, whole-batch proximal gradient descent, and the L1
optimality residual."""

import math

import numpy as np


def soft(v, s):
    return np.sign(v) * np.maximum(np.abs(v) - s, 0.0)


def coordinate_descent(A, b, lam, sweeps=2000):
    """Minimiser of 1/2 ||Aw - b||^2 + lam ||w||_1."""
    w, r, sq = np.zeros(A.shape[1]), -b.astype(float), (A * A).sum(0)
    for _ in range(sweeps):
        before = w.copy()
        for j in np.flatnonzero(sq):
            old = w[j]
            w[j] = soft(old - A[:, j] @ r / sq[j], lam / sq[j])
            r += A[:, j] * (w[j] - old)
        if np.abs(w - before).max() < 1e-14:
            break
    return w


def gradient_descent(A, b, lam, iters, step=0.1):
    w = np.zeros(A.shape[1])
    reg = 0.0
    hist = []
    for i in range(1, iters + 1):
        r = A @ w - b
        hist.append(0.5 * r @ r + reg)
        t = step / math.sqrt(i)
        w = soft(w - t * (A.T @ r), lam * t)
        reg = lam * np.abs(w).sum()
    return w, hist


def l1_residual(A, b, w, lam):
    g = A.T @ (A @ w - b)
    return np.where(w != 0, np.abs(g + lam * np.sign(w)), np.maximum(np.abs(g) - lam, 0.0))
