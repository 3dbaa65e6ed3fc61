"""pandas frames that Spark's Arrow conversion takes when empty as well."""

from __future__ import annotations

import pandas as pd


def frame(columns: dict) -> pd.DataFrame:
    """Columns of equal length; empty ones keep the object type, which converts to any Spark type."""
    return pd.DataFrame({k: v if len(v) else pd.Series([], dtype=object) for k, v in columns.items()})
