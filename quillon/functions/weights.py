"""Inverse-propensity weights of a handful of labels, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence


def agreement_of(labels: Sequence[Sequence[float]], max_ratio: float = 20.0) -> tuple[float, float]:
    """Weighted agreement and effective number of labels (propensity, ok); weights are capped at max_ratio times their upper median."""
    raw = [1 / p for p, _ in labels]
    cap = max_ratio * sorted(raw)[len(raw) // 2]
    w = [min(x, cap) for x in raw]
    total = sum(w)
    return sum(x * ok for x, (_, ok) in zip(w, labels, strict=True)) / total, total * total / sum(x * x for x in w)
