"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import boilerplate, history, languages, lookalikes, mixing, near_duplicates, neighbours, packing, spans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to (spark, sf_dir) -> DataFrame."""
    return {
        "p1_found": history.p1_found,
        "p2_found": lookalikes.p2_found,
        "p3_found": languages.p3_found,
        "p4_found": near_duplicates.p4_found,
        "p6_found": neighbours.p6_found,
        "p7_found": boilerplate.p7_found,
        "p8_containers": packing.p8_containers,
        "p9_mixture": mixing.p9_mixture,
        "p9_shares": mixing.p9_shares,
        "p10_found": spans.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    """Name to SQL; a query without SQL is tested against brute force, round trips or held-out text in tests/llm."""
    return {"p4_found": near_duplicates.P4_SQL, "p10_found": spans.P10_SQL}
