"""Choice of texts within a token budget, per group.

Within a group, texts are taken in order of priority and position; one that no longer fits is
skipped and the next is tried. The room left only shrinks, so once a text of some cost is
refused, every later one of that cost is refused as well: of the texts with cost c at most the
first budget/c can be taken. Everything after those and one refused witness is left out before a
group comes together, which bounds what one task holds by the budget, not by the group's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError
from featurespark.functions.columns import ref
from featurespark.functions.text import token_estimate

MAX_TOKENS = 8_000
RESERVED_TOKENS = 1_024
# Parts into which the rows of one group and cost are split for the first cut.
SPREAD = 4_096


def _chosen(
    df: DataFrame, group: str, position: str, text: str, priority: str | None, max_tokens: int, reserved_tokens: int
) -> DataFrame:
    """One row per group: positions kept in order, tokens used, whether something was left out."""
    budget = max_tokens - reserved_tokens
    if budget < 0:
        raise DataAccessError("more tokens are reserved than there are")
    slim = df.select(
        ref(group).alias("group"),
        (F.lit(0) if priority is None else ref(priority)).alias("priority"),
        ref(position).alias("position"),
        F.coalesce(token_estimate(ref(text)), F.lit(1).cast("bigint")).alias("cost"),
    )
    # Texts that cannot fit at all share one cost: a single witness of them is enough.
    slim = slim.withColumn("cost", F.least("cost", F.lit(budget + 1).cast("bigint")))
    possible = F.floor(F.lit(budget) / F.col("cost")) + 1
    part = F.pmod(F.xxhash64("position"), F.lit(SPREAD))
    candidates = slim
    for keys in (["group", "cost", part], ["group", "cost"]):
        order = Window.partitionBy(*keys).orderBy("priority", "position")
        # The literal bound follows from the other, as no text is free; by it rows are dropped before the shuffle.
        few = (F.col("nth") <= budget + 1) & (F.col("nth") <= possible)
        candidates = candidates.withColumn("nth", F.row_number().over(order)).where(few)
    entry = F.struct("priority", "position", "cost")
    ordered = F.array_sort(F.collect_list(entry))
    grouped = candidates.groupBy("group").agg(ordered.alias("entries"))
    position_type = slim.schema["position"].dataType.simpleString()
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.array().cast(f"array<{position_type}>").alias("kept"),
        F.lit(False).alias("truncated"),
    )

    def take(state, item):
        fits = state["used"] + item["cost"] <= budget
        return F.when(
            fits,
            F.struct(
                (state["used"] + item["cost"]).alias("used"),
                F.array_append(state["kept"], item["position"]).alias("kept"),
                state["truncated"].alias("truncated"),
            ),
        ).otherwise(F.struct(state["used"].alias("used"), state["kept"].alias("kept"), F.lit(True).alias("truncated")))

    return grouped.select("group", F.aggregate("entries", start, take).alias("state")).select(
        "group", "state.used", "state.kept", "state.truncated"
    )


def budget_summary(
    df: DataFrame,
    group: str,
    position: str,
    text: str,
    priority: str | None = None,
    max_tokens: int = MAX_TOKENS,
    reserved_tokens: int = RESERVED_TOKENS,
) -> DataFrame:
    """Per group: kept rows, tokens used, and whether a text was left out.

    ``position`` must be unique within a group.
    """
    chosen = _chosen(df, group, position, text, priority, max_tokens, reserved_tokens)
    return chosen.select(
        ref("group").alias(group),
        F.size("kept").cast("bigint").alias("kept_rows"),
        F.col("used").alias("estimated_tokens"),
        "truncated",
    )


def budget_select(
    df: DataFrame,
    group: str,
    position: str,
    text: str,
    priority: str | None = None,
    max_tokens: int = MAX_TOKENS,
    reserved_tokens: int = RESERVED_TOKENS,
) -> DataFrame:
    """The kept rows with all their columns and whole texts."""
    chosen = _chosen(df, group, position, text, priority, max_tokens, reserved_tokens)
    kept = chosen.select(F.col("group").alias("kept_group"), F.explode("kept").alias("kept_position"))
    # Joined on both columns, so the rows of one large group are spread over the join; null equals null.
    same = df[group].eqNullSafe(F.col("kept_group")) & df[position].eqNullSafe(F.col("kept_position"))
    return df.join(kept, same, "left_semi")
