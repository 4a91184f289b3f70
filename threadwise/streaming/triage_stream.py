"""Continuous triage: a stateless stream whose batches run against the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threadwise.operators.similarity import case_ids
from threadwise.operators.tfidf import TfidfIndex
from threadwise.plans.triage import triage
from threadwise.rules import fixed_values as fixed
from threadwise.rules.pack import SUPPORT_PACK, RulePack
from threadwise.session import passing_tables

MESSAGES = T.StructType(
    [T.StructField("msg_id", T.LongType()), T.StructField("message", T.StringType())]
)


def read_messages(
    spark: SparkSession, path: str, schema: T.StructType = MESSAGES, files_per_batch: int = 1000
) -> DataFrame:
    """Message files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def start_triage(
    messages: DataFrame,
    index: TfidfIndex,
    output: str,
    checkpoint: str,
    key: str = "msg_id",
    text: str = "message",
    k: int = fixed.REPORT_TOP_K,
    pack: RulePack = SUPPORT_PACK,
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Triage each batch into ``output/batch=<id>``.

    A replayed batch overwrites its own folder, so every message ends up there exactly once. Cases
    are written by their ids: ``with_cases`` reads their texts from the index.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        with passing_tables(batch.sparkSession):
            result = triage(batch.where(f"coalesce({text}, '') <> ''"), index, key, text, k, pack)
            case_ids(result).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
