"""Some of the scalar rules as SQL functions, for ``spark.sql``.

They are SQL expressions that Catalyst inlines into the plan, so they cost what the
Column forms cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MARKED, PLAIN

FUNCTIONS = {
    "sl_folded": ("t STRING", "STRING", f"translate(lower(coalesce(t, '')), '{MARKED}', '{PLAIN}')"),
    "sl_collapsed": ("t STRING", "STRING", r"trim(regexp_replace(coalesce(t, ''), '\\s+', ' '))"),
    "sl_words": ("t STRING", "ARRAY<STRING>", r"filter(split(coalesce(t, ''), '\\s+'), w -> w <> '')"),
    "sl_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0.0D END"),
    "sl_iou": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "DOUBLE", "try_divide(greatest(0.0D, least(b, d) - greatest(a, c)), greatest(b, d) - least(a, c))"),
    "sl_overlap": ("a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", "DOUBLE", "try_divide(greatest(0.0D, least(b, d) - greatest(a, c)), least(b - a, d - c))"),
    "sl_bounded": ("x DOUBLE", "DOUBLE", "least(100.0D, greatest(0.0D, x))"),
    "sl_grade": ("score DOUBLE", "STRING", "CASE WHEN score >= 75 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END"),
    "sl_search_score": ("semantic DOUBLE, lexical DOUBLE, ratio DOUBLE", "DOUBLE", "round(semantic * 70.0D + lexical * 20.0D + ratio * 10.0D, 2)"),
    "sl_slug": ("t STRING, most INT", "STRING", "left(regexp_replace(regexp_replace(sl_folded(t), '[^a-z0-9]+', '-'), '^-+|-+$', ''), most)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, for as long as it lasts; their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
