"""A bidirectional gated recurrent network over bytes, in numpy.

All arrays are (units, batch).  A direction has input weights ``e`` (3h, 256), read by
byte value, and state weights ``u`` (3h, h), each stacked as update gate, reset gate and
candidate.  ``v`` (labels, 2h) and ``c`` give the label scores of every position.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def start(hidden: int, labels: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "ef": draw(3 * hidden, 256, scale=0.3),
        "uf": draw(3 * hidden, hidden, scale=0.3),
        "eb": draw(3 * hidden, 256, scale=0.3),
        "ub": draw(3 * hidden, hidden, scale=0.3),
        "v": draw(labels, 2 * hidden, scale=0.3),
        "c": np.zeros((labels, 1), np.float32),
    }


def states(e: np.ndarray, u: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (steps, h, batch) over ``x`` (steps, batch)."""
    h = u.shape[1]
    out = np.empty((len(x), h, x.shape[1]), np.float32)
    state = np.zeros((h, x.shape[1]), np.float32)
    for t, symbols in enumerate(x):
        g = np.take(e, symbols, axis=1)
        gates = u[: 2 * h] @ state
        gates += g[: 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1.0
        gates *= 0.5
        new = u[2 * h :] @ (gates[h:] * state)
        new += g[2 * h :]
        np.tanh(new, out=new)
        if trace is not None:
            trace.append((state, gates, new))
        state = np.subtract(state, new, out=out[t])
        state *= gates[:h]
        state += new
    return out


def probabilities(p: Params, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(labels, steps, batch): the label probabilities of every position."""
    h = p["uf"].shape[1]
    traces: tuple = ([], []) if keep is not None else (None, None)
    forward = states(p["ef"], p["uf"], x, traces[0])
    backward = states(p["eb"], p["ub"], x[::-1], traces[1])[::-1]
    both = np.concatenate([forward, backward], axis=1).transpose(1, 0, 2).reshape(2 * h, -1)
    score = p["v"] @ both
    score += p["c"]
    score -= score.max(axis=0)
    np.exp(score, out=score)
    score /= score.sum(axis=0)
    if keep is not None:
        keep += [both, *traces]
    return score.reshape(-1, *x.shape)


def _through_time(
    u: np.ndarray, x: np.ndarray, trace: list, d_out: np.ndarray, d_e: np.ndarray, d_u: np.ndarray
) -> None:
    """Add the gradients of one direction to ``d_e`` and ``d_u``."""
    h = u.shape[1]
    carry = np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        before, gates, new = trace[t]
        z, r = gates[:h], gates[h:]
        d = carry + d_out[t]
        d_new = d * (1 - z) * (1 - new * new)
        d_reset = u[2 * h :].T @ d_new
        d_gates = np.concatenate(
            [d * (before - new) * z * (1 - z), d_reset * before * r * (1 - r)], axis=0
        )
        d_u[: 2 * h] += d_gates @ before.T
        d_u[2 * h :] += d_new @ (r * before).T
        np.add.at(d_e.T, x[t], np.concatenate([d_gates, d_new], axis=0).T)
        carry = d * z + d_reset * r + u[: 2 * h].T @ d_gates


def gradients(p: Params, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Mean loss over the weighted positions and its gradients."""
    h = p["uf"].shape[1]
    kept: list = []
    probs = probabilities(p, x, kept)
    both, forward, backward = kept
    total = max(float(weight.sum()), 1.0)
    picked = probs[y, :, np.arange(x.shape[1])].T
    loss = float(-(np.log(picked + 1e-12) * weight).sum() / total)
    d = probs.copy()
    d[y, :, np.arange(x.shape[1])] -= 1.0
    d = (d * (weight / total)).reshape(len(d), -1).astype(np.float32)
    out = {name: np.zeros_like(a) for name, a in p.items()}
    out["v"], out["c"] = d @ both.T, d.sum(axis=1, keepdims=True)
    d_both = (p["v"].T @ d).reshape(2 * h, *x.shape).transpose(1, 0, 2)
    _through_time(p["uf"], x, forward, d_both[:, :h], out["ef"], out["uf"])
    _through_time(p["ub"], x[::-1], backward, d_both[::-1, h:], out["eb"], out["ub"])
    return loss, out


def train(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    labels: int,
    hidden: int,
    epochs: int,
    batch: int = 128,
    rate: float = 0.02,
    seed: int = 7,
) -> Params:
    """Adam over windows ``x`` (steps, windows) with one label ``y`` a window."""
    p = start(hidden, labels, seed)
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(a) for k, a in p.items()}
    second = {k: np.zeros_like(a) for k, a in p.items()}
    step, steps = 0, max(1, epochs * -(-len(y) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            _, grads = gradients(p, x[:, rows], y[rows], weight[:, rows])
            step += 1
            now = rate * (1 - step / (steps + 1))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m, s = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
                p[k] = (p[k] - now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return p
