"""Batched non-negative ridge solves from sufficient statistics.

For one entity with rows (a_i, b_i) the solve

    w = argmin_{w >= 0}  sum_i (a_i.w - b_i)^2 + reg * |w|^2

needs only G = sum a_i a_i^T and c = sum b_i a_i, so an entity with any number
of rows is reduced to r(r+1)/2 + r numbers before it reaches one task.

Rows whose vector a_i is not known yet start at sqrt(b_i) * ones and are then
refined in turn with w. Their own solve has the closed form
``a_i = b_i * w / (|w|^2 + reg)``, so they too enter only through the sums of
b, b^1.5 and b^2.
"""

from __future__ import annotations

import numpy as np


def nonnegative_solve(gram: np.ndarray, rhs: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """argmin_{x>=0} x'Gx - 2c'x for a stack of positive definite problems.

    Block principal pivoting: guess the set of positive entries, solve on it,
    move every entry of the wrong sign to the other side, repeat. When that
    stops making progress only the last wrong entry moves, which ends the
    search after finitely many steps. Problems that are still open after
    ``sweeps`` steps per entry raise ArithmeticError.
    """
    n, r = rhs.shape
    x = np.zeros((n, r))
    if n == 0:
        return x
    size = np.maximum(np.abs(rhs).max(axis=1, keepdims=True), 1e-300)
    tol = 1e-12 * size
    scale = np.maximum(np.einsum("nii->ni", gram).max(axis=1, keepdims=True), 1e-300)
    passive = rhs > 0
    fewest = np.full(n, r + 1)
    tries = np.full(n, 3)
    todo = np.arange(n)
    eye = np.eye(r)
    for _ in range(sweeps * max(r, 1)):
        p = passive[todo]
        keep = p[:, :, None] & p[:, None, :]
        system = np.where(keep, gram[todo], eye * scale[todo][:, :, None])
        sol = np.linalg.solve(system, np.where(p, rhs[todo], 0.0)[..., None])[..., 0]
        sol = np.where(p, sol, 0.0)
        slope = np.einsum("nij,nj->ni", gram[todo], sol) - rhs[todo]
        wrong = (p & (sol < -tol[todo] / scale[todo])) | (~p & (slope < -tol[todo]))
        count = wrong.sum(axis=1)
        x[todo] = np.maximum(sol, 0.0)
        better = count < fewest[todo]
        fewest[todo] = np.where(better, count, fewest[todo])
        left = np.where(better, 3, tries[todo] - 1)
        tries[todo] = left
        last = r - 1 - np.argmax(wrong[:, ::-1], axis=1)
        only_last = np.zeros_like(wrong)
        only_last[np.arange(len(todo)), last] = True
        passive[todo] = p ^ np.where((left >= 0)[:, None], wrong, wrong & only_last)
        todo = todo[count > 0]
        if len(todo) == 0:
            break
    if len(todo):
        raise ArithmeticError(f"{len(todo)} of {n} non-negative solves did not end in {sweeps * max(r, 1)} steps")
    return x


def solve_entities(
    gram: np.ndarray,
    rhs: np.ndarray,
    unknown: np.ndarray,
    iters: int,
    reg: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Solve a stack of entities.

    ``unknown`` holds (count, sum b, sum b^1.5, sum b^2) of the rows without a
    vector. Returns the vectors w and, for the entities with unknown rows, the
    direction d such that the unknown row i ends at ``b_i * d``.
    """
    r = rhs.shape[1]
    ridge = max(reg, 1e-10) * np.eye(r)
    known = gram + ridge
    w = nonnegative_solve(known + unknown[:, 1, None, None], rhs + unknown[:, 2, None])
    direction = np.zeros_like(w)
    mixed = np.flatnonzero(unknown[:, 0] > 0)
    for _ in range(iters if len(mixed) else 0):
        v = w[mixed]
        length = (v * v).sum(axis=1, keepdims=True) + reg
        d = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        direction[mixed] = d
        squares = unknown[mixed, 3]
        w[mixed] = nonnegative_solve(
            known[mixed] + squares[:, None, None] * (d[:, :, None] * d[:, None, :]),
            rhs[mixed] + squares[:, None] * d,
        )
    return w, direction
