"""Token usage accounting over a call log (partial aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions.text import estimate_tokens


def call_log_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns (key, role, text) -> (key, input_tokens, output_tokens): the
    assistant's text is model output, everything else is prompt input."""
    tok = estimate_tokens("text")
    is_out = F.col("role") == "assistant"
    return turns.select(key,
                        F.when(~is_out, tok).otherwise(F.lit(0)).cast("bigint").alias("input_tokens"),
                        F.when(is_out, tok).otherwise(F.lit(0)).cast("bigint").alias("output_tokens"),
                        is_out.alias("is_call"))


def usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum input and output tokens (and their total), per group or overall."""
    aggs = [F.sum("input_tokens").cast("bigint").alias("input_tokens"),
            F.sum("output_tokens").cast("bigint").alias("output_tokens"),
            F.count_if("is_call").cast("bigint").alias("calls")]
    g = calls.groupBy(*by).agg(*aggs) if by else calls.agg(*aggs)
    return g.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
