"""Linear-map plug-ins (O44): how the rows of a design multiply coefficients.

A map is any object with

* ``coefficients(width)``: number of coefficients for rows of ``width`` stored features,
  and ``raw_width(p)``, its inverse;
* ``apply(M, V)``: products of a block of rows (rows x raw_width) with V (p x k);
* ``adjoint(M, S)``: its transpose times S (rows x g), a p x g matrix, added up over
  the blocks.

Both work on one block in a task. ``adjoint_gap`` checks that they belong together.
"""

from __future__ import annotations

import numpy as np

from penfit.operators.passes import CsrBlock


class MatrixMap:
    """The design's own matrix, dense or sparse."""

    def coefficients(self, width: int) -> int:
        return width

    def raw_width(self, p: int) -> int:
        return p

    def apply(self, M, V: np.ndarray) -> np.ndarray:
        if not isinstance(M, CsrBlock):
            return M @ V
        out = np.empty((M.rows, V.shape[1]))
        for j in range(V.shape[1]):
            out[:, j] = np.bincount(M.row, M.values * V[M.columns, j], M.rows)
        return out

    def adjoint(self, M: np.ndarray, S: np.ndarray) -> np.ndarray:
        return M.T @ S

    def adjoint_pairs(self, M: CsrBlock, S: np.ndarray):
        """Columns and the terms that go to them, one per entry."""
        return M.columns, M.values[:, None] * S[M.row]


class CentredMap:
    """A - 1 m': the design with its columns' means (or any row ``m``) taken off, without
    a centred copy of the rows."""

    def __init__(self, means):
        self.means = np.asarray(means, dtype=np.float64)

    def coefficients(self, width: int) -> int:
        return width

    def raw_width(self, p: int) -> int:
        return p

    def apply(self, M, V):
        return M @ V - self.means @ V

    def adjoint(self, M, S):
        return M.T @ S - np.outer(self.means, S.sum(axis=0))


class InterceptMap:
    """[1, A]: coefficient 0 is an intercept; the rows stay as they are."""

    def coefficients(self, width: int) -> int:
        return width + 1

    def raw_width(self, p: int) -> int:
        return p - 1

    def apply(self, M, V):
        return V[:1] + M @ V[1:]

    def adjoint(self, M, S):
        return np.vstack([S.sum(axis=0)[None, :], M.T @ S])


def adjoint_gap(evaluator, seed: int = 1) -> float:
    """|<A x, r> - <x, A' r>| over the size of the terms, for a random x and r = f(A x)
    row by row: 0 but for rounding if a map's two methods belong together. One scan."""
    x = np.random.default_rng(seed).standard_normal(evaluator.p)

    def rows(y, P):
        r = np.cos(3.0 * P[:, 0]) + y  # any vector over the rows
        return np.array([P[:, 0] @ r, np.abs(P[:, 0] * r).sum()]), r[:, None]

    _, (both, size), G = evaluator.scan(x.reshape(-1, 1), rows, 2, 1)
    return abs(both - float(x @ G[:, 0])) / max(size, 1e-300)
