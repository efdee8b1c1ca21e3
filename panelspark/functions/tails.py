"""Tail probabilities and derivatives of the gamma function as Column expressions, integrated as tails (no Python worker).

The density beyond the statistic is summed over ``NODES`` points of the exp-sinh rule,
whose spacing follows the density's own decay. All terms are positive and nothing is
subtracted from 1, so small tails keep their digits, and one rule serves every size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES, STEP, FIRST = 137, 0.0625, -4.5
SHIFT = 12


def _integral(t: str, scale: str, log_density: str) -> str:
    """The integral from ``t`` (>= 0) on of exp(log_density of s), twice."""
    y = f"({FIRST}D + k * {STEP}D)"
    points = f"transform(sequence(0, {NODES - 1}), k -> named_struct('u', exp({math.pi / 2}D * sinh{y}), 'w', {STEP * math.pi / 2}D * cosh{y}))"
    at = f"({t} + {scale} * p.u)"
    return f"2D * {scale} * aggregate({points}, 0D, (acc, p) -> acc + p.w * p.u * exp({log_density.format(s=at)}))"


def normal_two_sided_p(z: str) -> Column:
    """P(|Z| > |z|) of column ``z``."""
    a = f"abs(`{z}`)"
    inside = _integral(a, f"(1D / greatest({a}, 1D))", "-{s} * {s} / 2")
    return F.expr(f"CASE WHEN `{z}` IS NOT NULL THEN least({inside} / {math.sqrt(2 * math.pi)}D, 1D) END")


def _gamma_ratio(z: str) -> str:
    """Gamma(z + 1/2) / Gamma(z): the asymptotic series of its logarithm at z + SHIFT, and the recurrence back."""
    x = f"({z} + {SHIFT}D)"
    series = f"-1D / (8 * {x}) + 1D / (192 * pow({x}, 3)) - 1D / (640 * pow({x}, 5)) + 17D / (14336 * pow({x}, 7))"
    back = f"aggregate(sequence(0, {SHIFT - 1}), 1D, (acc, k) -> acc * ({z} + k) / ({z} + k + 0.5D))"
    return f"{back} * sqrt({x}) * exp({series})"


def digamma(z: str) -> str:
    """The derivative of ln Gamma for z > 0, as an expression: the asymptotic series at z + 10, and the recurrence back."""
    x = f"({z} + 10D)"
    series = f"ln({x}) - 1D / (2 * {x}) - 1D / (12 * pow({x}, 2)) + 1D / (120 * pow({x}, 4)) - 1D / (252 * pow({x}, 6)) + 1D / (240 * pow({x}, 8))"
    return f"({series} - ({' + '.join(f'1D / ({z} + {k}D)' for k in range(10))}))"


def trigamma(z: str) -> str:
    """The second derivative of ln Gamma for z > 0, likewise."""
    x = f"({z} + 10D)"
    series = f"1D / {x} + 1D / (2 * pow({x}, 2)) + 1D / (6 * pow({x}, 3)) - 1D / (30 * pow({x}, 5)) + 1D / (42 * pow({x}, 7)) - 1D / (30 * pow({x}, 9))"
    return f"({series} + {' + '.join(f'1D / pow({z} + {k}D, 2)' for k in range(10))})"


def t_two_sided_p(t: str, df: str) -> Column:
    """P(|T| > |t|) of column ``t`` for ``df`` degrees of freedom (an expression); null where df < 1 or there is no statistic."""
    a, nu = f"abs(`{t}`)", f"CAST({df} AS DOUBLE)"
    scale = f"(({nu} + {a} * {a}) / (({nu} + 1) * greatest({a}, 1D)))"
    inside = _integral(a, scale, f"-({nu} + 1) / 2 * log1p({{s}} * {{s}} / {nu})")
    ratio = _gamma_ratio(f"({nu} / 2)")
    return F.expr(f"CASE WHEN {df} >= 1 AND `{t}` IS NOT NULL THEN least({inside} * {ratio} / sqrt({nu} * {math.pi}D), 1D) END")
