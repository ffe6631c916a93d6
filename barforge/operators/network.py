"""A variable-selection network in numpy: softmax gates over embedded variables, a small head, trained by AdamW with early stopping."""

from __future__ import annotations

import numpy as np


class Network:
    """Gates g = softmax(V2 relu(V1 x)); context = sum of g_j (x_j W_j + B_j); logit = head(layer-normalised context)."""

    def __init__(self, n: int, hidden: int = 16, selector: int = 16, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        even = lambda rows, cols: rng.uniform(-1, 1, (rows, cols)) / rows**0.5
        self.p = {
            "v1": even(n, selector), "c1": np.zeros(selector), "v2": even(selector, n), "c2": np.zeros(n), "w": rng.uniform(-1, 1, (n, hidden)) * (6 / (n + hidden)) ** 0.5, "b": np.zeros((n, hidden)),
            "scale": np.ones(hidden), "shift": np.zeros(hidden), "h1": even(hidden, hidden), "d1": np.zeros(hidden), "h2": even(hidden, 1), "d2": np.zeros(1),
        }

    def forward(self, x: np.ndarray, drop=lambda a: np.ones_like(a)) -> tuple[np.ndarray, dict]:
        """Logits, and what the way back needs. ``drop`` gives the factors of a dropped layer."""
        p, k = self.p, {"x": x}
        k["s"] = x @ p["v1"] + p["c1"]
        k["sm"] = drop(k["s"])
        k["sr"] = np.maximum(k["s"], 0) * k["sm"]
        e = k["sr"] @ p["v2"] + p["c2"]
        e = np.exp(e - e.max(1, keepdims=True))
        k["g"] = e / e.sum(1, keepdims=True)
        context = (k["g"] * x) @ p["w"] + k["g"] @ p["b"]
        k["sd"] = np.sqrt(context.var(1, keepdims=True) + 1e-5)
        k["norm"] = (context - context.mean(1, keepdims=True)) / k["sd"]
        k["n"] = k["norm"] * p["scale"] + p["shift"]
        k["nm"] = drop(k["n"])
        k["nr"] = np.maximum(k["n"], 0) * k["nm"]
        k["h"] = k["nr"] @ p["h1"] + p["d1"]
        k["hm"] = drop(k["h"])
        k["hr"] = np.maximum(k["h"], 0) * k["hm"]
        return (k["hr"] @ p["h2"] + p["d2"])[:, 0], k

    def backward(self, out: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        """Slopes of all parameters from those of the logits."""
        p, x, g = self.p, k["x"], k["g"]
        d = {"h2": k["hr"].T @ out[:, None], "d2": out.sum(keepdims=True)}
        a = out[:, None] * p["h2"][:, 0] * k["hm"] * (k["h"] > 0)
        d["h1"], d["d1"] = k["nr"].T @ a, a.sum(0)
        a = a @ p["h1"].T * k["nm"] * (k["n"] > 0)
        d["scale"], d["shift"] = (a * k["norm"]).sum(0), a.sum(0)
        a = a * p["scale"]
        a = (a - a.mean(1, keepdims=True) - k["norm"] * (a * k["norm"]).mean(1, keepdims=True)) / k["sd"]
        d["w"], d["b"] = (g * x).T @ a, g.T @ a
        a = (a @ p["w"].T) * x + a @ p["b"].T
        a = g * (a - (a * g).sum(1, keepdims=True))
        d["v2"], d["c2"] = k["sr"].T @ a, a.sum(0)
        a = a @ p["v2"].T * k["sm"] * (k["s"] > 0)
        d["v1"], d["c1"] = x.T @ a, a.sum(0)
        return d

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.forward(x)[0], -700, 700)))

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Mean gate of each variable: its importance."""
        return self.forward(x)[1]["g"].mean(0)


def loss(z: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy with a weight on positives, and its slope by the logits."""
    s = np.where(y == 1, weight, 1.0)
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    return float((s * (np.logaddexp(0, z) - y * z)).mean()), s * (p - y) / len(y)


def fit(
    x: np.ndarray, y: np.ndarray, hidden: int = 16, selector: int = 16, dropout: float = 0.15, rate: float = 1e-3, decay: float = 1e-4, batch: int = 64, epochs: int = 60, patience: int = 8, held: float = 0.15, seed: int = 42,
) -> Network:
    """Trains on rows in order of time; the last ``held`` of them stop the training. Slopes are cut to length 1."""
    hidden, selector, batch, epochs, patience = (int(v) for v in (hidden, selector, batch, epochs, patience))
    n = len(x)
    n_val = min(max(1, int(np.ceil(n * held))), max(1, n - 2))
    a, b, va, vb = x[: n - n_val], y[: n - n_val], x[n - n_val :], y[n - n_val :]
    net, rng = Network(x.shape[1], hidden, selector, seed), np.random.default_rng(seed)
    weight = (b == 0).sum() / max(1, (b == 1).sum()) if (b == 1).any() else 1.0
    drop = lambda v: (rng.random(v.shape) >= dropout) / (1 - dropout)
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    t = 0
    best, kept, wait = np.inf, {k: p.copy() for k, p in net.p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for i in range(0, len(a), batch):
            at = order[i : i + batch]
            z, known = net.forward(a[at], drop)
            d = net.backward(loss(z, b[at], weight)[1], known)
            long = np.sqrt(sum((g * g).sum() for g in d.values()))
            t += 1
            for k, g in d.items():
                g = g * min(1.0, 1.0 / (long + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        now = loss(net.forward(va)[0], vb, weight)[0]
        if now < best - 1e-6:
            best, kept, wait = now, {k: p.copy() for k, p in net.p.items()}, 0
        else:
            wait += 1
            if wait >= patience:
                break
    net.p = kept
    return net
