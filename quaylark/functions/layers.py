"""Layer functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reinsurance(x: Column, limit: float | None = None, retention: float | None = None, share: float | None = None) -> Column:
    """min(max(x - retention, 0), limit) * share; what isn't given has no effect."""
    if retention is not None:
        x = F.greatest(x - F.lit(float(retention)), F.lit(0.0))
    if limit is not None:
        x = F.least(x, F.lit(float(limit)))
    return x if share is None else x * share


def franchise(x: Column, limit: float | None = None, retention: float | None = None) -> Column:
    """0 below the retention, which itself is kept; capped at limit + retention."""
    capped = x if limit is None else F.least(x, F.lit(float(limit + (retention or 0.0))))
    return capped if retention is None else F.when(x < float(retention), 0.0).otherwise(capped)


def split_retention(x: Column, limit: float | None, retention: float | None) -> Column:
    return reinsurance(x, limit, retention)


def split_franchise(x: Column, limit: float | None, retention: float | None) -> Column:
    """As the tower's split has it: strictly above the retention, capped at the limit."""
    capped = x if limit is None else F.least(x, F.lit(float(limit)))
    return capped if retention is None else F.when(x > float(retention), capped).otherwise(0.0)


def split_reverse_franchise(x: Column, limit: float | None, retention: float | None) -> Column:
    """Losses up to the retention, capped at the limit."""
    kept = x if retention is None else F.when(x <= float(retention), x).otherwise(0.0)
    return kept if limit is None else F.least(kept, F.lit(float(limit)))


SPLITS = {"retention": split_retention, "franchise": split_franchise, "reverse_franchise": split_reverse_franchise}
