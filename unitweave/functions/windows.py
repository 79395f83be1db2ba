"""Windows over a track."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def ahead(key: str, *order: str) -> WindowSpec:
    """Each row and all rows after it, in reverse order: the next value that is not null is ``last(..., True)`` over it.

    Spark goes through a frame that ends with the track anew for each row, so its time grows with the square of a
    track's rows; one that begins with the track is carried on."""
    return Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
