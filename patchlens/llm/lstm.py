"""A bidirectional LSTM that labels each step of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _back(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each sequence (step, sequence, ...) turned round in its own length."""
    at = np.arange(len(x))[:, None]
    turned = np.where(at < sizes, sizes - 1 - at, at)
    return x[turned, np.arange(x.shape[1])]


def initial(inputs: int, hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"out": r.normal(0, 0.1, 2 * hidden), "bias": np.zeros(1)}
    for d in "fb":
        w[f"x{d}"] = r.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
        w[f"h{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"c{d}"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # forget, input, output, new
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict, d: str, x: np.ndarray, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
    """Outputs of all steps from `state` (zeros if None) on, and what gradients need of each step (`keep`) or the last state."""
    steps, n, _ = x.shape
    k = w[f"h{d}"].shape[0]
    into = x @ w[f"x{d}"] + w[f"c{d}"]
    h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
    hs, held = np.empty((steps, n, k), np.float32), []
    for t in range(steps):
        g = into[t] + h @ w[f"h{d}"]
        s = _sigmoid(g[:, : 3 * k])
        f, i, o, new = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(g[:, 3 * k :])
        before, c = c, f * c + i * new
        tc = np.tanh(c)
        if keep:
            held.append((h, before, f, i, o, new, tc))
        h = o * tc
        hs[t] = h
    return hs, held if keep else (h, c)


def probabilities(w: dict, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(step, sequence) of sequences x (step, sequence, input) padded after their sizes."""
    f, _ = _run(w, "f", x, False)
    b, _ = _run(w, "b", _back(x, sizes), False)
    return _sigmoid(np.concatenate([f, _back(b, sizes)], 2) @ w["out"] + w["bias"])


def long_probabilities(w: dict, x: np.ndarray, stretch: int) -> np.ndarray:
    """As `probabilities` for one sequence (step, input), `stretch` steps at a time; each direction's state goes on from stretch to stretch."""

    def through(d: str, x: np.ndarray) -> np.ndarray:
        state, out = None, []
        for at in range(0, len(x), stretch):
            hs, state = _run(w, d, x[at : at + stretch, None], False, state)
            out.append(hs[:, 0])
        return np.concatenate(out)

    return _sigmoid(np.concatenate([through("f", x), through("b", x[::-1])[::-1]], 1) @ w["out"] + w["bias"])


def gradients(w: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all steps of all sequences, and its gradients."""
    xb = _back(x, sizes)
    (hf, kf), (hb, kb) = _run(w, "f", x, True), _run(w, "b", xb, True)
    both = np.concatenate([hf, _back(hb, sizes)], 2)
    p = _sigmoid(both @ w["out"] + w["bias"])
    mask = np.arange(len(x))[:, None] < sizes
    total = mask.sum()
    loss = -(np.log(np.where(y == 1, p, 1 - p) + 1e-9) * mask).sum() / total
    e = ((p - y) * mask / total).astype(np.float32)
    g = {"out": np.einsum("tnk,tn->k", both, e), "bias": e.sum(keepdims=True).reshape(1)}
    k = w["hf"].shape[0]
    for d, seq, held, up in (("f", x, kf, e[..., None] * w["out"][:k]), ("b", xb, kb, _back(e[..., None] * w["out"][k:], sizes))):
        dh, dc = np.zeros_like(held[0][0]), np.zeros_like(held[0][0])
        gates = np.empty((len(x), x.shape[1], 4 * k), np.float32)
        gh = np.zeros_like(w[f"h{d}"])
        for t in range(len(x) - 1, -1, -1):
            h, c, f, i, o, new, tc = held[t]
            dh = dh + up[t]
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc * c * f * (1 - f), dc * new * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - new * new)], 1)
            gates[t] = dg
            gh += h.T @ dg
            dh, dc = dg @ w[f"h{d}"].T, dc * f
        g |= {f"x{d}": np.einsum("tni,tnk->ik", seq, gates, optimize=True), f"h{d}": gh, f"c{d}": gates.sum((0, 1))}
    return float(loss), g


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights for sequences of (inputs, labels), by Adam."""
    r = np.random.default_rng(seed)
    w = initial(sequences[0][0].shape[1], hidden, seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(sequences))
        # sequences of similar length run together, which keeps the padding small
        order = np.concatenate([part[np.argsort([len(sequences[i][1]) for i in part], kind="stable")] for part in np.array_split(order, max(1, len(order) // (16 * batch)))])
        for at in r.permutation(np.arange(0, len(order), batch)).tolist():
            x, sizes, y = padded([sequences[i] for i in order[at : at + batch]])
            _, g = gradients(w, x, sizes, y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k in w:
                a = g[k] * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                w[k] = (w[k] - rate * 0.5 ** (epoch / 4) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(s[0]) for s in sequences])
    x = np.zeros((sizes.max(), len(sequences), sequences[0][0].shape[1]), np.float32)
    y = np.zeros(x.shape[:2], np.float32)
    for i, (a, b) in enumerate(sequences):
        x[: len(a), i], y[: len(a), i] = a, b
    return x, sizes, y
