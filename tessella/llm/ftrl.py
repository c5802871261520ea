"""Follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class FTRL:
    """Weights of shape (features,) or (features, classes); step() takes gradients at distinct features."""

    def __init__(self, shape, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(shape, np.float32)
        self.n = np.zeros(shape, np.float32)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, np.float32(0), (np.sign(z) * self.l1 - z) / step).astype(np.float32)

    def step(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more
