"""Scalar rules as SQL expressions that Spark and DuckDB read alike."""

from __future__ import annotations

#: Fixed values of the model: phase range, score clamp, logistic scale.
STAGES = 24
SCORE_CLAMP = 9900
LOGISTIC_SCALE = 206


def win_probability(x: str) -> str:
    """Chance to win at score x: a logistic in tens, four scales a decade."""
    return f"(1 / (1 + exp(-CAST({x} AS DOUBLE) / {LOGISTIC_SCALE} / 4 * ln(10.0D))))"


def round_div(a: str, b: str) -> str:
    """a / b to the nearest integer, halves up; b > 0."""
    return f"CAST(floor((({a}) + ({b}) / 2.0) / ({b})) AS BIGINT)"


def round_half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def clamp_score(x: str) -> str:
    return f"least(greatest({x}, -{SCORE_CLAMP}), {SCORE_CLAMP})"


def verdict(x: str) -> str:
    """win, loss or eval: scores beyond the clamp aren't evaluations."""
    return f"CASE WHEN {x} > {SCORE_CLAMP} THEN 'win' WHEN {x} < -{SCORE_CLAMP} THEN 'loss' ELSE 'eval' END"


def truncate_x100(w: str) -> str:
    """100 w without its fraction, towards zero."""
    return f"CAST(CASE WHEN ({w}) < 0 THEN -floor(-({w}) * 100) ELSE floor(({w}) * 100) END AS BIGINT)"
