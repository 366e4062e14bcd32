"""Parameters of the estimators: pure arithmetic on the graph's size and the accuracy asked for.

n nodes, m edges; eps relative error for scores of at least delta, failing with probability at most pfail.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

ALPHA = 0.2
POWER_LAW = 0.77  # exponent of the score distribution, for the score from which confidence bounds are kept


@dataclass(frozen=True)
class Params:
    n: int
    m: int
    eps: float
    delta: float
    pfail: float
    rmax: float = 0.0
    walks: float = 0.0
    rmax_self: float = 0.0
    walks_self: float = 0.0
    eps_self: float = 0.0
    delta_self: float = 0.0
    alpha: float = ALPHA

    @property
    def log_term(self) -> float:
        return math.log(2 / self.pfail)


def defaults(n: int, m: int, eps: float, delta: float | None = None, pfail: float | None = None) -> Params:
    if eps <= 0:
        raise ValueError("eps must be above 0")
    if n < 1 or m < 1:
        raise ValueError("the graph has no edges")
    return Params(n, m, eps, delta if delta is not None else 1 / n, pfail if pfail is not None else 1 / n)


def push_walk(p: Params, scale: float = 1.0) -> Params:
    """Forward push followed by walks from the residual."""
    return replace(p, rmax=p.eps * math.sqrt(p.delta / (3 * p.m * p.log_term)) * scale, walks=(2 + p.eps) * p.log_term / (p.delta * p.eps**2))


def bippr(p: Params, scale: float = 1.0) -> Params:
    """Reverse push from every target, walks from the source."""
    rmax = p.eps * math.sqrt(p.m * p.delta / (3 * p.log_term)) * scale
    return replace(p, rmax=rmax, walks=3 * rmax * p.log_term / (p.delta * p.eps**2))


hub = bippr


def bippr_self(p: Params) -> Params:
    """Reverse push from candidates, for their scores to themselves."""
    rmax = p.eps_self * math.sqrt(p.m * p.delta_self / (3 * p.n * p.log_term))
    return replace(p, rmax_self=rmax, walks_self=3 * rmax * p.log_term / (p.delta_self * p.eps_self**2))


def monte_carlo(p: Params) -> Params:
    return replace(p, walks=3 * p.log_term / (p.eps**2 * p.delta))


monte_carlo_hitting = monte_carlo


def monte_carlo_all(p: Params) -> Params:
    """Walks from every node: a score to itself is at least alpha."""
    return replace(p, walks=3 * p.log_term / (p.eps**2 * p.alpha))


def forward_push(p: Params, scale: float = 1.0) -> Params:
    """No guarantee: the residual is left out."""
    return replace(p, rmax=scale * p.delta * p.eps * p.n / p.m)


def hitting_raw(p: Params, ratio: float = 1.0) -> Params:
    """Hitting scores as a ratio of two estimates, with the error split between them. ratio: of the first error to the second."""
    p = replace(p, pfail=1 / (2 * p.n), delta=p.alpha / p.n, delta_self=p.alpha)
    both = ratio + 1 + p.eps
    p = replace(p, eps_self=p.eps / both, eps=p.eps * ratio / both)
    p = push_walk(p)
    rmax = p.eps_self * math.sqrt(p.delta_self * p.m / (p.n * p.alpha * (2 + p.eps_self) * p.log_term))
    return replace(p, rmax_self=rmax, walks_self=rmax * (2 + p.eps_self) * p.log_term / (p.delta_self * p.eps_self**2))


hitting = hitting_raw


def pairwise(p: Params) -> Params:
    rmax = p.eps * math.sqrt(p.m * p.delta / (p.n * (2 + p.eps) * p.log_term))
    return replace(p, rmax=rmax, walks=math.ceil(rmax * (2 + p.eps) * p.log_term / (p.delta * p.eps**2)))


def topk_pfail(n: int, halves: bool = False) -> float:
    """Failure probability of one round of a top-k search."""
    return 1 / (n * n * math.log(n)) / (2 if halves else 1)


def bound_threshold(n: int) -> float:
    """Confidence bounds are kept once delta is below the score expected of the 500th node under a power law."""
    return (1 - POWER_LAW) / 500**POWER_LAW / n ** (1 - POWER_LAW)


def multi_scale(cores: int) -> float:
    return math.sqrt(cores + 1)


def deviation(rsum: float, pfail: float, upper: float, walks: float) -> float:
    """Bernstein-type deviation of a sum of walk weights."""
    term = math.log(2 / pfail)
    return rsum * term / (3 * walks) + math.sqrt(4 / 9 * term**2 * rsum**2 + 8 * walks * term * rsum * upper) / (2 * walks)


def cost_forward(edge_visits: float, walks: float) -> float:
    return 1.4 * edge_visits + 2 * walks


def cost_reverse(candidates: int, rmax: float, n: int, m: int, alpha: float = ALPHA) -> float:
    return candidates / rmax * m / n / alpha
