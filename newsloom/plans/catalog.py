"""Registry of the core queries and of their SQL.

``query`` registers a plan built with the DataFrame API together with SQL for a
second engine; ``shared_sql`` registers a plan that is stated as SQL.  The SQL
of both dialects is the same but for the few functions in ``DIALECTS``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ("articles", "feed_items", "stories", "article_embeddings", "article_content", "sources", "feed_locale", "documents", "events", "embeddings", "region", "nation", "customer", "orders", "lineitem", "supplier", "part")

#: Function names by dialect: (Spark, DuckDB).
DIALECTS = {
    "MS(": ("unix_millis(", "epoch_ms("),
    "FROM_MS(": ("timestamp_millis(", "make_timestamptz(1000 * "),
    "CODE_POINTS(": ("char_length(", "length("),
    "SHA256(": ("sha256_hex(", "sha256("),
    "IDIV": ("div", "//"),
    "HOUR_OF(": ("date_trunc('HOUR', ", "date_trunc('hour', "),
}


def dialect(sql: str, duckdb: bool) -> str:
    """A shared SQL text in one of the two dialects."""
    for name in sorted(DIALECTS, key=len, reverse=True):
        sql = re.sub(rf"(?<![A-Z_a-z]){re.escape(name)}", DIALECTS[name][duckdb].replace("\\", r"\\"), sql)
    return sql if duckdb else sql.replace("sha256_hex(", "sha2_256(")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a shared SQL text on the tables of a scale directory."""
    text = re.sub(r"sha2_256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", dialect(sql, duckdb=False))
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for name in used:
        text = re.sub(rf"(?<=\bFROM )\s*{name}\b|(?<=\bJOIN )\s*{name}\b", "{" + name + "}", text)
    bound = {t: table(spark, sf_dir, t) for t in used if "{" + t + "}" in text}
    return spark.sql(text, **bound)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent in the second engine, where SQL can express it."""

    def register(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = dialect(sql, duckdb=True)
        return plan

    return register


def shared_sql(name: str, sql: str) -> None:
    """Register a query that both engines run from one text."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    QUERIES[name].__doc__ = f"Plan of {name}, stated as SQL."
    SQL[name] = dialect(sql, duckdb=True)
