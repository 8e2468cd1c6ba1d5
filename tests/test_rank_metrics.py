"""Ranks and Kendall's tau-b against plain definitions."""

import numpy as np
import pytest

from newsloom.operators import vectors


def _plain_tau(x, y):
    """Concordant less discordant element pairs over the root of the untied ones of each side."""
    s = nx = ny = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            a, b = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
            s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
    return s / np.sqrt(nx * ny) if nx and ny else np.nan


@pytest.mark.parametrize("d", [1, 2, 9, 40])
@pytest.mark.parametrize("columns", [1, 7, 4096])
def test_kendall_in_groups_of_element_pairs(monkeypatch, d, columns):
    monkeypatch.setattr(vectors, "SIGN_COLUMNS", columns)
    rng = np.random.default_rng(d)
    A, B = rng.integers(0, 6, (4, d)).astype(float), rng.normal(size=(3, d))
    A[0] = 2.0
    want = np.array([[_plain_tau(a, b) for b in B] for a in A])
    np.testing.assert_allclose(vectors._kendall(A, B), want, atol=1e-12)


def test_average_ranks_with_ties():
    rng = np.random.default_rng(3)
    X = np.vstack([rng.integers(0, 4, (5, 17)).astype(float), np.zeros((1, 17)), rng.normal(size=(2, 17))])
    want = [[np.sum(x < v) + (np.sum(x == v) + 1) / 2 for v in x] for x in X]
    np.testing.assert_array_equal(vectors._avg_ranks(X), want)
