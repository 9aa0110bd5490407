"""Recognition errors of turns that were read badly: traces, confusions, items found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import edits as E
from quern.plans.registry import query
from quern.sources.tables import spread, table


def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text and `seen`, the turn as a reader gave it: among other text, letters taken for others, dropped and doubled."""
    c = spread(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    worse = F.regexp_replace(F.regexp_replace(F.translate("text", "eo,", "c0"), "th|ch", "h"), "(?<=[a-z])s ", "ss ")
    return c.select("conv_id", "turn", "text", F.concat_ws(" ", "role", F.lit("see page"), worse, F.lit("end of page")).alias("seen"))


@query()
def edit_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn against what was read of the page: edits, and each operation with its place and characters."""
    return E.with_trace(read_turns(spark, sf_dir), "text", "seen").select("conv_id", "turn", "edits", "ops")


@query()
def character_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters were read as which others, missed or added, over all turns."""
    return E.confusions(edit_traces(spark, sf_dir))


@query()
def sentences_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences of a turn were read exactly, with few errors, or not."""
    rows = read_turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("key"), F.split("text", r"\. ").alias("items"), "seen")
    return E.found_items(rows, "key", "items", "seen").select("key.*", "place", "item", "edits", "found")
