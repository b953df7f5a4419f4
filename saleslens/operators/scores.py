"""Recency, frequency and monetary scores of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import first_match
from .ranking import add_ntiles


# Segments of the analyses with the least scores of recency, frequency and monetary value.
SEGMENTS = {"best": "Champions", "loyal": "Loyal Customers", "new": "New Customers", "risk": "At Risk", "lost": "Lost Customers", "rest": "Need Attention"}


def score_customers(df: DataFrame, key: str) -> DataFrame:
    """Scores 1-5 (5 is best) from recency_days, frequency and monetary.

    Equal values are told apart by the key, so scores are the same on every run.
    """
    return add_ntiles(
        df,
        [
            ("recency_score", 5, [("recency_days", False), (key, True)]),
            ("frequency_score", 5, [("frequency", True), (key, True)]),
            ("monetary_score", 5, [("monetary", True), (key, True)]),
        ],
    ).withColumn("rfm_cell", F.concat("recency_score", "frequency_score", "monetary_score"))


def rfm_segment(at_risk_frequency: int) -> Column:
    """Segment of the three scores; the first rule that holds counts."""
    recency, frequency, monetary = (F.col(f"{part}_score") for part in ("recency", "frequency", "monetary"))
    return first_match(
        [
            ((recency >= 4) & (frequency >= 4) & (monetary >= 4), SEGMENTS["best"]),
            ((recency >= 3) & (frequency >= 3), SEGMENTS["loyal"]),
            (recency >= 4, SEGMENTS["new"]),
            (frequency >= at_risk_frequency, SEGMENTS["risk"]),
            ((recency <= 2) & (frequency <= 2) & (monetary <= 2), SEGMENTS["lost"]),
        ],
        SEGMENTS["rest"],
    )
