"""vitalis: many-user health-log analytics on Spark DataFrames.

Layout
------
sources/    table readers, derived input tables, fixed dimensions, raw band CSV
            lines and model-output JSON cleaning
functions/  column expressions (targets, unit conversion, flags, fuzzy score, ...)
operators/  DataFrame -> DataFrame operators (band daily, matching, weights, ...)
plans/      composite results (weekly check-in, readiness) and the query registry
streaming/  Structured Streaming delivery of the band import
"""

__all__ = ["session"]
