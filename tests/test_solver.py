import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.functions.solver import nonnegative_solve, solve_entities


def _solve(a, b, reg, iters=0, unknown=()):
    a, b = np.asarray(a, float), np.asarray(b, float)
    u = np.asarray(unknown, float)
    sums = np.array([[len(u), u.sum(), (u**1.5).sum(), (u**2).sum()]])
    return solve_entities((a.T @ a)[None], (a.T @ b)[None], sums, iters, reg)


def test_rank_one():
    w, _ = _solve([[1], [2]], [4, 2], 0.1)
    assert w[0, 0] == pytest.approx(1.568627, abs=1e-6)


def test_rank_two():
    w, _ = _solve([[1, 0.2], [0.1, 1]], [4, 2], 0.1)
    assert w[0] == pytest.approx([3.358857, 1.572231], abs=1e-6)


def test_unknown_row_has_closed_form():
    w = np.array([1.0, 0.0])
    assert 3 * w / (w @ w + 0.5) == pytest.approx([2.0, 0.0])
    assert brute.nonnegative(w[None, :], [3.0], 0.5) == pytest.approx([2.0, 0.0])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 8), st.sampled_from([0.01, 0.1, 1]))
def test_matches_enumeration(seed, rank, rows, reg):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(rows, rank)), rng.uniform(0.5, 5, rows)
    got = nonnegative_solve((a.T @ a + reg * np.eye(rank))[None], (a.T @ b)[None])[0]
    assert got == pytest.approx(brute.nonnegative(a, b, reg), abs=1e-8)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(0, 4), st.integers(1, 3),
       st.integers(0, 4))
def test_alternation_matches_row_by_row(seed, rank, known, unknown, iters):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 2, (known, rank)), rng.uniform(0.5, 5, known + unknown)
    w, d = _solve(a, b[:known], 0.1, iters, b[known:])
    vectors = [*a, *[None] * unknown]
    want, found = brute.solve(vectors, b, rank, iters, 0.1)
    assert w[0] == pytest.approx(want, abs=1e-8)
    for i, vector in found.items():
        if iters:
            assert b[i] * d[0] == pytest.approx(vector, abs=1e-8)


@pytest.mark.parametrize("rank", [10, 50, 100])
def test_optimality_of_a_stack(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(0.3, 1, (40, 60, rank))
    gram = np.einsum("nij,nik->njk", a, a) + 0.1 * np.eye(rank)
    rhs = np.einsum("nij,ni->nj", a, rng.uniform(0.5, 5, (40, 60)))
    x = nonnegative_solve(gram, rhs)
    slope = np.einsum("nij,nj->ni", gram, x) - rhs
    assert (x >= 0).all()
    assert (slope > -1e-6).all()
    assert np.abs(x * slope).max() < 1e-6


def test_unfinished_solves_raise():
    """Vectors that had no step to be solved in are not returned as if solved."""
    gram = np.array([np.eye(2), [[1.0, 0.99], [0.99, 1.0]]])
    rhs = np.array([[1.0, 2.0], [1.0, 0.1]])
    with pytest.raises(ArithmeticError, match="2 of 2"):
        nonnegative_solve(gram, rhs, sweeps=0)
    assert np.allclose(nonnegative_solve(gram, rhs), [[1, 2], [1, 0]])
