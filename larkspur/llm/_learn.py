"""Small models fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, sample_weight: np.ndarray | None = None, steps: int = 50) -> Logistic:
        """Newton's method with an L2 penalty; finite for any data, one class only included."""
        w = np.ones(len(y)) if sample_weight is None else sample_weight
        w = w / max(w.sum(), 1e-12)
        mean = w @ x
        scale = np.sqrt(w @ (x - mean) ** 2)
        scale[scale < 1e-9] = 1.0
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        beta = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ (w * (p - y)) + ridge * beta
            hess = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            size = np.abs(step).max()
            beta -= step * min(1.0, 3.0 / max(size, 1e-12))
            if size < 1e-8:
                break
        return cls(mean, scale, beta[:-1], float(beta[-1]))

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of rows, gradient and Hessian of the loss over rows, in one array; such arrays of parts of a table add up."""
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ np.append(self.weights, self.bias), -30, 30)))
        hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
        return np.concatenate([[len(x)], z.T @ (p - y), hess.ravel()])

    def stepped(self, sums: np.ndarray, penalty: float) -> Logistic:
        """One of Newton's steps with an L2 penalty, by weighted ``sums``."""
        beta = np.append(self.weights, self.bias)
        ridge = np.full(len(beta), penalty)
        ridge[-1] = 1e-6
        n, grad, hess = max(sums[0], 1e-12), sums[1 : 1 + len(beta)], sums[1 + len(beta) :].reshape(len(beta), -1)
        step = np.linalg.solve(hess / n + np.diag(ridge), grad / n + ridge * beta)
        beta = beta - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        return Logistic(self.mean, self.scale, beta[:-1], float(beta[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))
