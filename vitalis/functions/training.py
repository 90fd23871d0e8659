"""Training expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, truthy


def e1rm(weight, reps) -> Column:
    """Epley estimated one-rep max: w * (1 + reps / 30); 0 when either is
    missing or zero."""
    w, r = col(weight), col(reps)
    return F.when(truthy(w) & truthy(r), w * (1 + r / 30)).otherwise(F.lit(0.0))
