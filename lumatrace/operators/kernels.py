"""Recursions along the frames, for many traces at once: Viterbi paths and forward-backward sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """A hidden Markov model of classes: start, mean, spread, transition probabilities a frame."""

    p0: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    a: np.ndarray
    fix_mu: bool = False
    fix_sigma: bool = False

    @staticmethod
    def of(mu: list[float], sigma: float | list[float] = 0.06, stay: float = 0.95) -> Model:
        k = len(mu)
        a = np.full((k, k), (1 - stay) / max(1, k - 1))
        np.fill_diagonal(a, stay if k > 1 else 1.0)
        return Model(np.full(k, 1 / k), np.array(mu, float), np.broadcast_to(np.array(sigma, float), (k,)).copy(), a)


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(x), -1e10)


def usable(x: np.ndarray) -> int:
    """Frames up to the last that is not 0."""
    on = np.flatnonzero(x != 0)
    return int(on[-1]) + 1 if len(on) else 0


def _chunks(lengths: np.ndarray, least: int, cells: int = 400_000):
    """Indices of traces of at least `least` frames, longest first, in chunks that padded hold at most `cells` frames (or one trace)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= least]
    at = 0
    while at < len(order):
        many = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + many]
        at += many


def _padded(xs: list[np.ndarray], own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames by traces (frame, trace), and for each frame how many of the traces, longest first, have it."""
    x = np.zeros((int(lengths[own[0]]), len(own)))
    for j, i in enumerate(own):
        x[: lengths[i], j] = xs[i][: lengths[i]]
    return x, np.searchsorted(-lengths[own], -np.arange(len(x)), side="left")


def viterbi_all(xs: list[np.ndarray], models: Model | list[Model]) -> list[tuple[np.ndarray, float]]:
    """viterbi() of many traces, for one model or one each: the recursion steps through the frames of all traces at once."""
    each = [models] * len(xs) if isinstance(models, Model) else models
    lengths = np.array([usable(x) for x in xs], np.int64)
    out = [(np.zeros(len(x), np.int64), float("nan")) for x in xs]
    for own in _chunks(lengths, 2):
        x, have = _padded(xs, own, lengths)
        p0, mu, sigma, a = (np.stack([getattr(each[i], c) for i in own]) for c in ("p0", "mu", "sigma", "a"))
        e = _log(0.001 / (np.sqrt(2 * np.pi) * sigma)) - (x[:, :, None] - mu) ** 2 / (2 * sigma**2)
        step, back, score = _log(a), np.zeros(e.shape, np.int16), _log(p0) + e[0]
        for t in range(1, len(x)):
            n = have[t]
            by = score[:n, :, None] + step[:n]
            back[t, :n] = by.argmax(axis=1)
            score[:n] = by.max(axis=1) + e[t, :n]
        rows = np.arange(len(own))
        s = score.argmax(axis=1)
        best, states = score[rows, s] / lengths[own], np.zeros(x.shape, np.int64)
        for t in range(len(x) - 1, -1, -1):
            n = have[t]
            states[t, :n] = s[:n] + 1
            s[:n] = back[t, rows[:n], s[:n]]
        for j, i in enumerate(own):
            out[i][0][: lengths[i]] = states[: lengths[i], j]
            out[i] = (out[i][0], float(best[j]))
    return out


def viterbi(x: np.ndarray, m: Model) -> tuple[np.ndarray, float]:
    """Most probable states (from 1; 0 after the last frame that is not 0) and log likelihood a frame."""
    return viterbi_all([x], m)[0]


def _refit(x: np.ndarray, s: np.ndarray, m: Model) -> Model:
    """The model of one trace's frames and states (from 0)."""
    k = len(m.mu)
    a = 0.01 * np.eye(k)
    np.add.at(a, (s[:-1], s[1:]), 1)
    p0 = np.full(k, 0.01)
    p0[s[0]] += 1
    mu, sigma = m.mu.copy(), m.sigma.copy()
    for i in range(k):
        own = x[s == i]
        if len(own) and not m.fix_mu:
            mu[i] = own.mean()
        if len(own) > 1 and not m.fix_sigma:
            sigma[i] = max(0.01, own.std(ddof=1))
    return Model(p0 / p0.sum(), mu, sigma, a / a.sum(axis=1, keepdims=True), m.fix_mu, m.fix_sigma)


def segmental_kmeans_all(xs: list[np.ndarray], m: Model, rounds: int = 100, tolerance: float = 1e-4) -> list[tuple[np.ndarray, Model, float]]:
    """segmental_kmeans() of many traces, each with a model of its own; those that have settled leave the rounds."""
    out: list[tuple[np.ndarray, Model, float]] = [(np.zeros(len(x), np.int64), m, float("nan")) for x in xs]
    open_, last = list(range(len(xs))), np.full(len(xs), -np.inf)
    for _ in range(rounds):
        found = viterbi_all([xs[i] for i in open_], [out[i][1] for i in open_])
        left = []
        for i, (states, best) in zip(open_, found, strict=True):
            model = out[i][1]
            if np.isfinite(best):
                n = usable(xs[i])
                model = _refit(xs[i][:n], states[:n] - 1, model)
                if abs(best - last[i]) >= tolerance:
                    left.append(i)
            out[i], last[i] = (states, model, best), best
        open_ = left
        if not open_:
            break
    return out


def segmental_kmeans(x: np.ndarray, m: Model, rounds: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, Model, float]:
    """Viterbi and re-estimation by turns until the likelihood settles."""
    return segmental_kmeans_all([x], m, rounds, tolerance)[0]


def forward_backward_all(xs: list[np.ndarray], m: Model, cut: int = 1) -> dict[str, np.ndarray | float] | None:
    """forward_backward() summed over many traces, stepping through the frames of all of them at once."""
    lengths = np.array([usable(x) - cut for x in xs], np.int64)
    k, total, tiny = len(m.mu), None, np.finfo(float).eps
    for own in _chunks(lengths, 5):
        x, have = _padded(xs, own, lengths)
        on = np.arange(len(own)) < have[:, None]
        b = np.exp(-((x[:, :, None] - m.mu) ** 2) / (2 * m.sigma**2)) / (np.sqrt(2 * np.pi) * m.sigma) / 100
        b[b.sum(axis=2) == 0] = tiny
        alpha, scale = np.zeros_like(b), np.ones(x.shape)
        for t in range(len(x)):
            n = have[t]
            alpha[t, :n] = (m.p0 if t == 0 else alpha[t - 1, :n] @ m.a) * b[t, :n]
            sums = alpha[t, :n].sum(axis=1)
            scale[t, :n] = np.where(sums == 0, tiny, sums)
            alpha[t, :n] /= scale[t, :n, None]
        beta, xi = np.ones_like(b), np.zeros((k, k))
        for t in range(len(x) - 2, -1, -1):
            n = have[t + 1]
            after = b[t + 1, :n] * beta[t + 1, :n] / scale[t + 1, :n, None]
            xi += m.a * (alpha[t, :n].T @ after)
            beta[t, :n] = after @ m.a.T
        gamma = alpha * beta
        gamma /= np.where(on, gamma.sum(axis=2), 1.0)[:, :, None]
        flat = gamma.reshape(-1, k)
        part = {"ll": float(np.log(scale).sum()), "g1": gamma[0].sum(axis=0), "xi": xi, "g": flat.sum(axis=0), "gx": flat.T @ x.ravel(), "gxx": flat.T @ x.ravel() ** 2}
        total = part if total is None else {c: total[c] + v for c, v in part.items()}
    return total


def forward_backward(x: np.ndarray, m: Model, cut: int = 1) -> dict[str, np.ndarray | float] | None:
    """Sums that re-estimation needs of one trace, without its last `cut` usable frames; None if under 5 are left."""
    return forward_backward_all([x], m, cut)
