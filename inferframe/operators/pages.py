"""Documents as pages: splitting texts, and merging page results into document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_TEXT, TOO_MANY_PAGES

#: The flags of a page analysis and its image sources, worst first.
FLAGS = ("contains_handwriting", "contains_unreadable_or_ambiguous_text", "background_is_noisy", "contains_faint_text", "contains_blurred_text", "contains_distorted_text", "contains_cutoff_text", "glare_on_some_text")
SOURCES = ("PHOTO_OR_VIDEO", "SCAN", "DIGITAL")

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint>"


def split_pages(df: DataFrame, text: str, separator: str = "\n", page: str = "page_text") -> DataFrame:
    """A row for each part of a text, with page_idx from 0."""
    import re

    return df.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), re.escape(separator), -1)).alias("page_idx", page))


def number_pages(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds page_idx: the place, from 0, of each part among those with its key."""
    return df.withColumn("page_idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def page_id(document: Column, page_idx: Column) -> Column:
    """Id of a page as JSON text: that of its document (JSON text) and its number."""
    return F.concat(F.lit("["), document, F.lit(","), page_idx.cast("string"), F.lit("]"))


def first_pages(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else df.where(F.col("page_idx") < most)


def incomplete_message(total: Column, most: int | None) -> Column:
    """The message of a document with more pages than were asked for, else null."""
    if most is None:
        return F.lit(None).cast("string")
    return F.when(total > most, F.format_string(TOO_MANY_PAGES, F.lit(most), total))


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), source).cast("int") - 1


def source_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SOURCES)), rank)


def analysis_columns(prefix: str = "") -> list[Column]:
    """Aggregates of page analyses: any flag of the pages with text, and the worst image source; null without an analysis."""
    with_text = F.col("text").isNotNull()
    flags = [F.bool_or(F.when(with_text, F.col(f"analysis.{f}"))).alias(f"{prefix}{f}") for f in FLAGS]
    rank = F.min(F.when(with_text, source_rank(F.col("analysis.image_source"))))
    return [source_name(rank).alias(f"{prefix}image_source"), *flags]


def is_flagged(analysis: Column) -> Column:
    """Whether a page or document has any flag but background noise."""
    found = F.lit(False)
    for f in FLAGS:
        if f != "background_is_noisy":
            found = found | F.coalesce(analysis[f], F.lit(False))
    return found


def merge_pages(pages: DataFrame, keys: list[str], include_page_breaks: bool = False, max_pages: int | None = None, carry: list[str] | None = None, with_analysis: bool = False) -> DataFrame:
    """Document rows from page rows: status, text, errors, page_count, estimated_cost, token_usage.

    pages has the keys, page_idx (null: the document has no page), text (null: the
    page failed), errors, and may have estimated_cost, token_usage, analysis,
    total_pages and warnings (of the document, on each row), and error (of the whole
    document, which then fails). `carry` columns are the same on all of a
    document's rows. Costs and usage count for pages with text only, and are null
    if they add up to nothing. One shuffle, combined on the map side but for the texts themselves.
    """
    has = set(pages.columns)
    null = F.lit(None)
    cost = F.col("estimated_cost") if "estimated_cost" in has else null.cast("double")
    usage = F.col("token_usage") if "token_usage" in has else null.cast(USAGE)
    total = F.col("total_pages") if "total_pages" in has else null.cast("bigint")
    good = F.col("text").isNotNull()
    real = F.col("page_idx").isNotNull()
    page = F.when(real, F.struct("page_idx", "text", "errors"))
    aggregates = [
        F.array_sort(F.collect_list(page)).alias("_pages"),
        F.count_if(real).alias("page_count"),
        F.count_if(real & good).alias("_good"),
        F.max(total).alias("_total"),
        F.sum(F.when(good, cost)).alias("_cost"),
        F.sum(F.when(good, usage["prompt_tokens"])).alias("_in"),
        F.sum(F.when(good, usage["completion_tokens"])).alias("_out"),
        F.first(F.col("warnings") if "warnings" in has else F.array().cast("array<string>"), ignorenulls=True).alias("_warnings"),
        F.max(F.col("error") if "error" in has else null.cast("string")).alias("_error"),
        *(F.first(c, ignorenulls=True).alias(c) for c in carry or []),
        *(analysis_columns("_a_") if with_analysis else []),
    ]
    out = pages.groupBy(*keys).agg(*aggregates)
    message = incomplete_message(F.coalesce("_total", "page_count"), max_pages)
    separator = "\n\f\n" if include_page_breaks else "\n\n"
    text = F.array_join(F.transform("_pages", lambda p: F.coalesce(p["text"], F.lit(NO_TEXT))), separator)
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("_warnings", none), F.flatten(F.transform("_pages", lambda p: F.coalesce(p["errors"], none))), F.when(message.isNotNull(), F.array(message)).otherwise(none))
    whole = message.isNull() & (F.col("_good") == F.col("page_count"))
    failed = F.col("_error").isNotNull()
    columns = [
        F.when(failed, "failed").when(whole, "ok").when(F.col("_good") > 0, "incomplete").otherwise("failed").alias("status"),
        F.when(failed, F.array("_error")).otherwise(errors).alias("errors"),
        F.when(~failed & (F.col("_good") > 0), text).alias("text"),
        F.when(~failed, F.col("page_count")).alias("page_count"),
        F.when(~failed & (F.col("_cost") > 0), F.col("_cost")).alias("estimated_cost"),
        F.when(~failed & (F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0)) > 0), F.struct(F.coalesce("_in", F.lit(0)).cast("bigint").alias("prompt_tokens"), F.coalesce("_out", F.lit(0)).cast("bigint").alias("completion_tokens"))).alias("token_usage"),
    ]
    if with_analysis:
        merged = F.struct(F.col("_a_image_source").alias("image_source"), *(F.col(f"_a_{f}").alias(f) for f in FLAGS))
        columns.append(F.when(~failed & F.col("_a_image_source").isNotNull(), merged).alias("analysis"))
    return out.select(*keys, *(carry or []), *columns)
