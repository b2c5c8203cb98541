"""Rows from Python to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """One frame of rows, none where there are no rows: an empty frame has no column types, and
    Arrow does not take it."""
    if rows:
        yield pd.DataFrame(rows, columns=columns)
