"""Documents merged from pages that come over many batches, in any order: pages wait in state until their document is complete."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pages import merge_pages


def complete_documents(pages: DataFrame, keys: Sequence[str], page: str = "page_idx", total: str = "total_pages", wait_ms: int | None = None) -> DataFrame:
    """The rows of a stream of pages, held back until all pages of their document have come.

    A document's key, and the number of pages that its rows name (the largest counts), say what is missing; the state
    holds the rows of documents that aren't complete, and nothing of those that are. A page that comes twice while it waits
    counts once, the first time. Rows without a page number or a total pass at once. With wait_ms a document that has had no new page for
    so long goes on as it is.
    """
    names = pages.columns
    packed = pages.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(page).cast("long").alias("_page"), F.col(total).cast("long").alias("_total"), F.to_json(F.struct(*names)).alias("_row"))
    key_fields = [T.StructField(f"_k{i}", pages.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*key_fields, T.StructField("_row", T.StringType())])
    state_type = T.StructType([T.StructField("total", T.LongType()), T.StructField("pages", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(T.StringType()))])
    key_names = [f.name for f in key_fields]

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def emitted(rows: list[str]) -> pd.DataFrame:
            return pd.DataFrame([(*key, r) for r in rows], columns=[*key_names, "_row"])

        needed, seen, rows = state.get if state.exists else (0, [], [])
        needed, seen, rows = needed or 0, list(seen), list(rows)
        if state.hasTimedOut:
            state.remove()
            yield emitted(rows)
            return
        at_once, known = [], set(seen)
        for pdf in frames:
            for number, of, row in zip(pdf["_page"], pdf["_total"], pdf["_row"], strict=True):
                if pd.isna(number) or pd.isna(of):
                    at_once.append(row)
                elif int(number) not in known:
                    known.add(int(number))
                    seen.append(int(number))
                    rows.append(row)
                    needed = max(needed, int(of))
        if seen and len(seen) >= needed:
            if state.exists:
                state.remove()
            at_once += rows
        elif seen:
            state.update((needed, seen, rows))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        yield emitted(at_once)

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    found = packed.groupBy(*key_names).applyInPandasWithState(gather, out, state_type, "append", timeout)
    return found.select(F.from_json("_row", pages.schema).alias("r")).select("r.*")


def merge_page_stream(pages: DataFrame, keys: Sequence[str], write: Callable[[DataFrame, int], None], checkpoint: str, wait_ms: int | None = None, once: bool = True, **options) -> StreamingQuery:
    """Starts a query that merges the pages of a stream into documents and hands each batch of these to `write` with its number.

    Pages wait in state (complete_documents); each batch's complete documents are merged as in a table, so the result of all
    batches is that of merge_pages over all pages. options: as merge_pages. A query that is started again goes on from its checkpoint; `write` may get a
    batch again after a failure, under the same number. once: all that is there, then an end.
    """
    ready = complete_documents(pages, keys, wait_ms=wait_ms)
    writer = ready.writeStream.foreachBatch(lambda batch, number: write(merge_pages(batch, list(keys), **options), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
