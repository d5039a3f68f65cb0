"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(**columns: Column) -> Column:
    """Columns out of a generator: no later filter or projection can be merged with them and run them again."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
