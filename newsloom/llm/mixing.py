"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / weight, with u from a hash of
its id and the weight its quality; in the order of their keys the documents of
a source are a weighted sample without replacement of any size.  A source that
needs more tokens than it has goes through complete epochs first, and the rest
is the longest run of smallest keys within the remaining budget.

Scale.  A source of any size is never sorted in one task: keys fall into
``CELLS`` cells in their order, token sums by source and cell (map-side
combined) tell in which cell the budget ends, and only that cell's documents
are put in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom.llm.tokens import TOKENIZER, tokenizer
from newsloom.plans.runtime import park, table

#: Cells that the keys of a source are divided into.
CELLS = 4096
_LETTERS = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"\w+")


def source_key(source: Column) -> Column:
    """One spelling of a source name: lower-case letters and digits."""
    return F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")


def quality(text: str) -> float:
    """Weight between 0.05 and 1: share of letters among visible characters times variety of words (root of distinct over all)."""
    visible = len(text) - text.count(" ") - text.count("\n")
    found = _WORDS.findall(text.lower())
    if not visible or not found:
        return 0.05
    # variety falls with length, so long texts are compared in stretches of 200 words
    parts = [found[i : i + 200] for i in range(0, len(found), 200)]
    variety = float(np.mean([len(set(p)) / len(p) for p in parts]))
    return round(max(0.05, min(1.0, len(_LETTERS.findall(text)) / visible * variety**0.5)), 6)


def _measured(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    key_type = rows.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("source_key"), pa.array([reader.count(t) for t in texts], pa.int64()), pa.array([quality(t) for t in texts], pa.float64())], names=["key", "source_key", "tokens", "weight"])

    return rows.mapInArrow(measure, f"key {key_type}, source_key string, tokens long, weight double").filter("tokens > 0")


def mix_sources(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer_path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): the documents of a mixture with their repeat counts, and what each source contributes.

    ``targets`` has one row per source: ``source``, ``target_share`` (summing to
    1), ``max_repeats``; sources are the same if they differ only in letter
    case, blanks and punctuation.  The budget is ``total_tokens``, by default
    the tokens of all the sources' documents.  A source below its share even at
    ``max_repeats`` is taken as often as allowed and reported as ``capped``; one
    without documents contributes nothing.

    ``chosen``: ``key``, ``source``, ``tokens``, ``weight``, ``repeats``.
    ``shares``: ``source``, ``target_share``, ``max_repeats``, ``available_tokens``,
    ``documents``, ``epochs``, ``chosen_tokens``, ``actual_share``, ``capped``.

    Null keys, null sources, and null or empty texts are left out; repeated rows
    count once; ties of keys go to the smaller id; an empty table gives an empty
    choice and shares of zero.
    """
    wanted = targets.select("source", source_key(F.col("source")).alias("source_key"), "target_share", "max_repeats")
    rows = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), source_key(F.col(source_col)).alias("source_key")).filter("key is not null and text <> ''")
    rows = rows.join(wanted.select("source_key").distinct(), "source_key", "left_semi").select("key", "text", "source_key")
    measured = _measured(rows, tokenizer_path).distinct()
    u = (F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = measured.withColumn("rank_key", -F.log(u) / F.col("weight"))
    # -ln(u) / w has its largest weight 1, so this is monotone in the key and fills the cells
    keyed = park(keyed.withColumn("cell", F.floor((1 - F.exp(-F.col("rank_key") * 0.5)) * CELLS).cast("int")), "mix-keys")

    by_cell = keyed.groupBy("source_key", "cell").agg(F.sum("tokens").alias("cell_tokens"), F.count(F.lit(1)).alias("n"))
    sums = by_cell.groupBy("source_key").agg(F.sum("cell_tokens").alias("available_tokens"), F.sum("n").alias("documents"))
    plan = wanted.join(sums, "source_key", "left").na.fill(0, ["available_tokens", "documents"])
    whole = F.lit(total_tokens).cast("double") if total_tokens is not None else F.sum("available_tokens").over(Window.partitionBy(F.lit(1))).cast("double")
    plan = plan.withColumn("budget", F.floor(F.col("target_share") * whole + 1e-6))
    plan = plan.withColumn("epochs", F.when(F.col("available_tokens") > 0, F.least(F.col("max_repeats").cast("long"), F.floor(F.col("budget") / F.col("available_tokens")))).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), 0).otherwise(F.col("budget") - F.col("epochs") * F.col("available_tokens")))
    plan = park(plan, "mix-plan")

    up_to = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_cell.withColumn("before", F.coalesce(F.sum("cell_tokens").over(up_to), F.lit(0))).join(plan.select("source_key", "rest"), "source_key")
    cells = cells.filter("before < rest").withColumn("inside", F.col("before") + F.col("cell_tokens") <= F.col("rest")).select("source_key", "cell", "before", "rest", "inside")
    located = keyed.join(cells, ["source_key", "cell"])
    in_order = Window.partitionBy("source_key", "cell").orderBy("rank_key", "key")
    last = located.filter(~F.col("inside")).withColumn("reach", F.col("before") + F.sum("tokens").over(in_order)).filter("reach <= rest")
    fraction = located.filter("inside").select("key", "source_key").unionByName(last.select("key", "source_key")).withColumn("extra", F.lit(1).cast("long"))
    chosen = keyed.join(plan.select("source_key", "source", "epochs"), "source_key").join(fraction, ["key", "source_key"], "left")
    chosen = chosen.withColumn("repeats", F.col("epochs") + F.coalesce("extra", F.lit(0))).filter("repeats > 0")
    chosen = park(chosen.select("key", "source", "source_key", "tokens", "weight", "repeats"), "mix-chosen")

    reached = chosen.groupBy("source_key").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"))
    shares = plan.join(reached, "source_key", "left").na.fill(0, ["chosen_tokens"])
    total = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.select(
        "source", "target_share", "max_repeats", "available_tokens", "documents", "epochs", "chosen_tokens",
        F.when(total > 0, F.round(F.col("chosen_tokens") / total, 6)).otherwise(0.0).alias("actual_share"),
        (F.col("budget") > F.col("available_tokens") * F.col("max_repeats")).alias("capped"),
    )
    return chosen.drop("source_key"), shares


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with repeat counts, each with its source's target and actual share."""
    chosen, shares = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))
    return chosen.join(shares.select("source", "target_share", "actual_share", "capped"), "source").withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of ``mix_targets`` contributes."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[1]
