"""Runs a prompt over files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chat import RunOptions, chat, write_results
from ..operators.prompt import Prompt
from ..operators.providers import LlmOptions, Provider


def watch_folder(spark: SparkSession, folder: str, schema: str, prompt: str | dict | Prompt, out: str, checkpoint: str, provider: str | Provider = "echo", model: str = "echo", options: LlmOptions = LlmOptions(), available_now: bool = True, on_counters=None) -> StreamingQuery:
    """Starts a query that writes JSON lines with the results of each batch of new JSONL files to a folder of its own.

    A batch's folder is named by its number and replaced if the batch runs again after a
    failure, so every input row has one result. The counters of each batch
    are taken from what was written and go to `on_counters(batch, summary)`. There is no state and no event time.
    """
    source = spark.readStream.schema(schema).json(folder)

    def one(batch: DataFrame, number: int) -> None:
        run = RunOptions(allow_reordering=True)
        summary = write_results(chat(batch, prompt, provider, model, run, options), f"{out.rstrip('/')}/batch={number}", run)
        if on_counters:
            on_counters(number, summary)

    writer = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
