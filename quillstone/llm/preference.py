"""Preference formatting: one prompt and two masked completions from a pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Start and end, in code points of the rendered turns, of what a trained role says with its closing mark."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)

    def walk(at: Column, t: Column) -> Column:
        start = at["end"] + head + F.length(t["role"])
        stop = start + F.length(t["text"]) + tail
        own = F.when(t["role"] == trained, F.array(F.struct(start.alias("start"), stop.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(stop.alias("end"), F.concat(at["spans"], own).alias("spans"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, walk, lambda at: at["spans"])


def preference_pairs(turns: DataFrame, pair: str, rejected: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each pair: prompt, chosen and rejected completion and their trained spans.

    pair names the column of the pair, rejected a boolean column that tells the two sides
    apart. The longest run of equal turns (role and text) from the start is the prompt,
    rendered once; what follows on each side is its completion, and the spans cover the
    trained role's turns in it. Rows with a null pair, side or turn belong to no
    conversation and are left out; null roles and texts count as empty. Turns that repeat
    a number, repeated rows included, keep the order of role and text and count each. Of a
    pair with one side n_common is 0, the prompt empty and the missing side's completion
    null. Texts of any length are rendered whole, an empty table gives no rows and other
    columns are ignored, whatever their names.
    """
    said = turns.filter(F.col(pair).isNotNull() & F.col(rejected).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(pair).alias("pair_id"),
        F.col(rejected).alias("is_rejected"),
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    sides = said.groupBy("pair_id").agg(
        F.min(F.when(~F.col("is_rejected"), F.col("conv"))).alias("chosen_conv"),
        F.min(F.when(F.col("is_rejected"), F.col("conv"))).alias("rejected_conv"),
        F.array_sort(F.collect_list(F.when(~F.col("is_rejected"), F.col("said")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("is_rejected"), F.col("said")))).alias("b"),
    )
    same = F.zip_with("a", "b", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    differs = F.array_position(same, F.lit(False))
    counted = sides.withColumn("n_common", F.when(differs == 0, F.size("a")).otherwise(differs - 1).cast("int"))
    rest = counted.withColumns({f"{s}_rest": F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s), F.lit(1))) for s in "ab"})
    return rest.select(
        "pair_id",
        "chosen_conv",
        "rejected_conv",
        "n_common",
        F.size("a").alias("n_chosen"),
        F.size("b").alias("n_rejected"),
        _render(F.slice("a", 1, F.col("n_common"))).alias("prompt"),
        F.when(F.size("a") > 0, _render(F.col("a_rest"))).alias("chosen"),
        F.when(F.size("b") > 0, _render(F.col("b_rest"))).alias("rejected"),
        _spans(F.col("a_rest"), trained).alias("chosen_spans"),
        _spans(F.col("b_rest"), trained).alias("rejected_spans"),
    )
