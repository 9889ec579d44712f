"""Sentiment and price expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three labels.
POSITIVE, NEUTRAL, NEGATIVE = "POSITIVE", "NEUTRAL", "NEGATIVE"


def signed_score(label: Column | str, conf: Column | str) -> Column:
    """Confidence with the sign of its label; every label but POSITIVE counts as negative."""
    label = F.col(label) if isinstance(label, str) else label
    conf = F.col(conf) if isinstance(conf, str) else conf
    return F.when(label == POSITIVE, conf).otherwise(-conf) + F.lit(0.0)


def score_label(score: Column | str, neutral: bool = True) -> Column:
    """Label of a signed score; without ``neutral`` zero counts as negative."""
    score = F.col(score) if isinstance(score, str) else score
    named = F.when(score > 0, POSITIVE)
    if neutral:
        named = named.when(score == 0, NEUTRAL)
    return F.when(score.isNotNull(), named.otherwise(NEGATIVE))


def mid_price(high: Column | str = "high", low: Column | str = "low") -> Column:
    high = F.col(high) if isinstance(high, str) else high
    low = F.col(low) if isinstance(low, str) else low
    return (high + low) / 2


def normalized(value: Column, lo: Column, hi: Column) -> Column:
    """Position of a value between two bounds, NULL where the bounds meet."""
    return F.try_divide(value - lo, hi - lo)


def fixed(c: Column, digits: int = 12) -> Column:
    """A computed double without the noise of its last bits, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def round_even(c: Column | str, digits: int) -> Column:
    """Rounding with ties to the even digit.

    Values are first fixed to nine decimals, so that the order in which a sum
    was added up cannot decide a tie.
    """
    return F.bround(F.round(c, 9), digits)
