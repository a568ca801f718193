"""Small models fitted on the driver from bounded reviewed samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def _climb(start: np.ndarray, objective, derivatives, rounds: int = 200) -> np.ndarray:
    """Newton steps on a concave objective, each halved until it gains: plain steps can run away where
    the sample is nearly separable."""
    w, value = start, objective(start)
    for _ in range(rounds):
        grad, hess = derivatives(w)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6:
            new = objective(w + size * step)
            if new > value:
                break
            size /= 2
        else:
            return w
        gained, w, value = new - value, w + size * step, new
        if gained < 1e-10 * (1.0 + abs(value)):
            return w
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic weights for 0/1 labels."""

    def objective(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (y * z - np.logaddexp(0.0, z))).sum() - 0.5 * ridge * (w @ w))

    def derivatives(w: np.ndarray):
        p = sigmoid(x @ w)
        return x.T @ (weight * (y - p)) - ridge * w, (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))

    return _climb(np.zeros(x.shape[1]), objective, derivatives)


def choice(sets: list[tuple[np.ndarray, int]], prior: np.ndarray) -> np.ndarray:
    """Conditional logit: each set's rows compete and one is chosen; ridge of 1 around the prior."""

    def objective(w: np.ndarray) -> float:
        total = -0.5 * float((w - prior) @ (w - prior))
        for x, y in sets:
            z = x @ w
            top = z.max()
            total += float(z[y] - top - np.log(np.exp(z - top).sum()))
        return total

    def derivatives(w: np.ndarray):
        grad, hess = prior - w, np.eye(len(w))
        for x, y in sets:
            z = x @ w
            p = np.exp(z - z.max())
            p /= p.sum()
            mean = p @ x
            grad = grad + x[y] - mean
            hess = hess + (x.T * p) @ x - np.outer(mean, mean)
        return grad, hess

    return _climb(prior.copy(), objective, derivatives)
