"""Small linear models, fitted by Newton's method on dense features of a bounded sample."""

from __future__ import annotations

import numpy as np


def with_intercept(features: np.ndarray) -> np.ndarray:
    return np.hstack([features, np.ones((len(features), 1), features.dtype)])


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def logistic(features: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression on a 0/1 target."""
    x, size = with_intercept(features.astype(np.float32)), features.shape[1] + 1
    weights = np.zeros(size)
    share = (target.sum() + 1) / (len(target) + 2)
    weights[-1] = np.log(share / (1 - share))
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ weights.astype(np.float32)).astype(np.float64)
        gradient = x.T @ (p - target).astype(np.float32) + penalty * weights
        curve = (x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None].astype(np.float32))).astype(np.float64)
        step = np.linalg.solve(curve + np.diag(penalty), gradient)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def support_vector(features: np.ndarray, sign: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights, the intercept last, of a linear support vector machine with squared hinge loss."""
    x = with_intercept(features.astype(np.float32))
    sign = sign.astype(np.float32)
    weights = np.zeros(x.shape[1], np.float32)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.maximum(1 - sign * (x @ w), 0)
        return float(0.5 * w @ w + cost * (slack**2).sum()), slack

    value, slack = loss(weights)
    for _ in range(rounds):
        on = slack > 0
        own = x[on]
        gradient = weights - 2 * cost * (own.T @ (sign * slack)[on])
        if np.linalg.norm(gradient) < 1e-3 * cost:
            break
        # Conjugate gradients on the curvature of the points inside the margin.
        step, rest = np.zeros_like(weights), -gradient
        way, left = rest.copy(), rest @ rest
        for _ in range(30):
            bent = way + 2 * cost * (own.T @ (own @ way))
            scale = left / (way @ bent)
            step += scale * way
            rest -= scale * bent
            now = rest @ rest
            if now < 1e-4 * (gradient @ gradient):
                break
            way, left = rest + now / left * way, now
        length = 1.0
        while length > 1e-3:
            new_value, new_slack = loss(weights + length * step)
            if new_value <= value + 1e-4 * length * (gradient @ step):
                break
            length /= 2
        weights, value, slack = weights + length * step, new_value, new_slack
    return weights
