"""One SQL spelling for rounding, rates and means, and for the shaped tables."""

from __future__ import annotations

import re

from saleslens.sources.given_tables import SHAPES


def rounded(value: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rounded(f"CAST({part} AS DOUBLE) * 100 / nullif({whole}, 0)", digits)


def avg(value: str, digits: int = 2) -> str:
    return rounded(f"CAST(sum({value}) AS DOUBLE) / nullif(count({value}), 0)", digits)


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def small(value: str) -> str:
    return f"CAST({value} AS INTEGER)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def with_shapes(body: str) -> str:
    """Put the shaped tables that a text names in front of it."""
    used = [name for name in SHAPES if re.search(rf"\b{name}\b", body)]
    shapes = ", ".join(f"{name} AS ({SHAPES[name].strip()})" for name in used)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {shapes}, {body[5:]}"
    return f"WITH {shapes} {body}"


def segment_of(recency: str, frequency: str, monetary: str, at_risk_frequency: int) -> str:
    """The segment rules, in the order in which they count, over three scores."""
    rules = [
        ((4, 4, 4), ">=", "Champions"),
        ((3, 3, None), ">=", "Loyal Customers"),
        ((4, None, None), ">=", "New Customers"),
        ((None, at_risk_frequency, None), ">=", "At Risk"),
        ((2, 2, 2), "<=", "Lost Customers"),
    ]
    cases = []
    for limits, sign, name in rules:
        conditions = [f"{c} {sign} {n}" for c, n in zip((recency, frequency, monetary), limits) if n is not None]
        cases.append(f"WHEN {' AND '.join(conditions)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'Need Attention' END"


def scored(source: str, at_risk_frequency: int, segment: str) -> str:
    """Common tables `scored` and `named`: fifths of three figures (5 is best), ties by customer, and the segment."""
    orders = {"r": "recency_days DESC NULLS LAST", "f": "frequency NULLS FIRST", "m": "monetary NULLS FIRST"}
    fifths = ", ".join(f"ntile(5) OVER (ORDER BY {order}, customer_id) AS {name}" for name, order in orders.items())
    return f"""
    scored AS (SELECT *, {fifths} FROM {source}),
    named AS (SELECT *, concat(r, f, m) AS rfm_cell, {segment_of("r", "f", "m", at_risk_frequency)} AS {segment} FROM scored)"""
