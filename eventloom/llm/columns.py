"""Keeping a table's own columns apart from those an operator adds under the same names."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hidden(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with clashing columns renamed, and the way back to its columns."""
    to = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(to), lambda out: out.select(*(F.col(f"`{to.get(c, c)}`").alias(c) for c in docs.columns))
