"""Two-state linear-chain conditional random field, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Chains(NamedTuple):
    """Chains of tokens side by side, longest first: a token's place is start + step."""

    starts: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(starts: np.ndarray, lengths: np.ndarray) -> Chains:
        order = np.argsort(-lengths, kind="stable")
        return Chains(starts[order], lengths[order])


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(evidence: np.ndarray, transition: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 per token, and of both states being 1 per token and the one before.

    ``evidence`` is the log-weight of state 1 against state 0 per token, ``transition``
    (2, 2) the log-weight of a state after another. Messages are kept as log-odds, and
    all chains take a step at a time.
    """
    n = len(evidence)
    ahead, back = np.zeros(n), np.zeros(n)
    (t00, t01), (t10, t11) = transition
    starts, lengths = chains
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    ahead[starts] = evidence[starts]
    for step in range(1, longest):
        at = starts[: active[step]] + step
        before = ahead[at - 1]
        ahead[at] = evidence[at] + log_add(t01, t11 + before) - log_add(t00, t10 + before)
    for step in range(longest - 2, -1, -1):
        at = starts[: active[step + 1]] + step
        following = back[at + 1] + evidence[at + 1]
        back[at] = log_add(t10, t11 + following) - log_add(t00, t01 + following)
    marginal = 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))
    pair = np.zeros(n)
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    if len(at):
        before, after = ahead[at - 1], evidence[at] + back[at]
        weights = np.stack([np.full(len(at), t00), t01 + after, t10 + before, t11 + before + after])
        weights = np.exp(weights - weights.max(0))
        pair[at] = weights[3] / weights.sum(0)
    return marginal, pair


def fit(
    features: np.ndarray, labels: np.ndarray, chains: Chains, size: int, epochs: int = 100, rate: float = 0.5, ridge: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, transition) by gradient ascent on the log-likelihood of
    labelled chains. ``features`` is (tokens, features per token); weight ``size`` is the bias."""
    weights, transition = np.zeros(size + 1), np.zeros((2, 2))
    seen, seen_transition = np.full(size + 1, 1e-8), np.full((2, 2), 1e-8)
    inner = np.ones(len(labels), bool)
    inner[chains.starts] = False
    at = np.flatnonzero(inner)
    both = labels[at] * labels[at - 1]
    for _ in range(epochs):
        evidence = weights[features].sum(1) + weights[size]
        marginal, pair = forward_backward(evidence, transition, chains)
        error = labels - marginal
        gradient = np.bincount(features.ravel(), np.repeat(error, features.shape[1]), size + 1)
        gradient[size] = error.sum()
        gradient -= ridge * weights
        seen += gradient**2
        weights += rate * gradient / np.sqrt(seen)
        got = np.array([both.sum(), (labels[at - 1] - both).sum(), (labels[at] - both).sum()])
        p_before, p_here, p_both = marginal[at - 1], marginal[at], pair[at]
        meant = np.array([p_both.sum(), (p_before - p_both).sum(), (p_here - p_both).sum()])
        step = np.zeros((2, 2))
        step[1, 1], step[1, 0], step[0, 1] = got - meant
        step[0, 0] = -(step.sum())
        step -= ridge * transition
        seen_transition += step**2
        transition += rate * step / np.sqrt(seen_transition)
    return weights, transition
