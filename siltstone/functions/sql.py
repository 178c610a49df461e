"""The library's statistics as functions of SQL, for sessions that work by ``spark.sql``.

They are SQL functions, so Catalyst inlines them; nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .exprs import Z95

Z = f"{Z95!r}D"

FUNCTIONS = {
    "wilson_lo": f"(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0D, (k / n + {Z} * {Z} / (2 * n) - {Z} * sqrt((k / n) * (1 - k / n) / n + {Z} * {Z} / (4D * n * n))) / (1 + {Z} * {Z} / n)) END",
    "wilson_hi": f"(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(1D, (k / n + {Z} * {Z} / (2 * n) + {Z} * sqrt((k / n) * (1 - k / n) / n + {Z} * {Z} / (4D * n * n))) / (1 + {Z} * {Z} / n)) END",
    "js_term": "(p DOUBLE, q DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p > 0 THEN 0.5D * p * ln(p / greatest((p + q) / 2, 1e-12D)) ELSE 0D END + CASE WHEN q > 0 THEN 0.5D * q * ln(q / greatest((p + q) / 2, 1e-12D)) ELSE 0D END",
    "binomial_se": "(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN sqrt((k / n) * (1 - k / n) / n) END",
    "months": "(first STRING, last STRING) RETURNS TABLE (ym STRING) RETURN SELECT date_format(m, 'yyyyMM') FROM (SELECT explode(sequence(to_date(first, 'yyyyMM'), to_date(last, 'yyyyMM'), INTERVAL 1 MONTH)) AS m)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
