"""Plain re-statements of the solves, for small inputs."""

from itertools import product

import numpy as np


def nonnegative(a, b, reg):
    """argmin_{w>=0} |Aw-b|^2 + reg|w|^2 by trying every set of positive entries."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    r = a.shape[1]
    best, best_cost = np.zeros(r), b @ b
    for use in product([False, True], repeat=r):
        use = np.array(use)
        if not use.any():
            continue
        sub = a[:, use]
        x = np.zeros(r)
        x[use] = np.linalg.solve(sub.T @ sub + reg * np.eye(use.sum()), sub.T @ b)
        if (x < 0).any():
            continue
        cost = ((a @ x - b) ** 2).sum() + reg * x @ x
        if cost < best_cost - 1e-15:
            best, best_cost = x, cost
    return best


def solve(vectors, ratings, rank, iters, reg):
    """(w, {index of unknown row: vector}) by alternating; None is unknown."""
    unknown = [i for i, v in enumerate(vectors) if v is None]
    a = np.array([np.sqrt(r) * np.ones(rank) if v is None else v
                  for v, r in zip(vectors, ratings)], float)
    w = nonnegative(a, ratings, reg)
    for _ in range(iters if unknown else 0):
        for i in unknown:
            a[i] = nonnegative(w[None, :], [ratings[i]], reg)
        w = nonnegative(a, ratings, reg)
    return w, {i: a[i] for i in unknown}


def prefixes(train, items, rank, iters, reg, most):
    """{(j, user): w} with film factors created on the way; ``train`` maps a
    user to (film, rating) in order."""
    items = {k: np.float32(v) for k, v in items.items()}
    out = {}
    for j in range(1, most + 1):
        proposals = {}
        for user, rows in train.items():
            if len(rows) < j:
                continue
            w, found = solve([items.get(m) for m, _ in rows[:j]], [r for _, r in rows[:j]],
                             rank, iters, reg)
            out[j, user] = w
            for i, vector in found.items():
                proposals.setdefault(rows[i][0], []).append(np.float32(vector))
        for film, vectors in proposals.items():
            items[film] = np.float32(np.mean(np.array(vectors, float), axis=0))
    return out
