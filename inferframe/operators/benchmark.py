"""Offline quality report of recognition models against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import is_flagged
from .similarity import compare_texts

METADATA = "struct<format:string,documentQuality:string,fontFamily:string,rotation:double>"


def read_images(raw: DataFrame) -> DataFrame:
    """Ground-truth rows with their JSON-in-text decoded: metadata once, the Markdown as a JSON string."""
    return raw.withColumns({"metadata": F.from_json("metadata", METADATA), "true_markdown": F.try_variant_get(F.try_parse_json("true_markdown_output"), "$", "string")})


def first_images(images: DataFrame, n: int = 100) -> DataFrame:
    return images.orderBy("id").limit(n)


def with_issues(images: DataFrame, issues: DataFrame, key: str = "id", image_key: str = "image_id") -> DataFrame:
    """Adds ground_truth_issue; issues of unknown images have no effect."""
    i = issues.groupBy(F.col(image_key).alias("_image")).agg(F.min("issue").alias("ground_truth_issue"))
    return images.join(i, images[key] == F.col("_image"), "left").drop("_image")


def unknown_issues(images: DataFrame, issues: DataFrame, key: str = "id", image_key: str = "image_id") -> DataFrame:
    """Issues that name no image, for a warning."""
    return issues.join(images.select(F.col(key).alias("_key")), issues[image_key] == F.col("_key"), "left_anti")


def compare_outputs(images: DataFrame, outputs: DataFrame, key: str = "id", truth: str = "true_markdown", text: str = "text", lists: bool = True) -> DataFrame:
    """A row for each image and model: jaccard, counts of differing tokens (and with `lists` these tokens, as diff), and whether the result is flagged."""
    joined = images.join(outputs.select(F.col(key).alias("_key"), "model", F.col(text).alias("_text"), *(["analysis"] if "analysis" in outputs.columns else [])), images[key] == F.col("_key"), "left").drop("_key")
    out = compare_texts(joined, F.col(truth), F.col("_text"), F.col("model").isNotNull(), lists)
    if "analysis" in out.columns:
        out = out.withColumn("flagged", is_flagged(F.col("analysis")))
    return out.withColumnRenamed("_text", "output_text")


def model_averages(results: DataFrame, by: str = "model", excluded: Column | None = None) -> DataFrame:
    """Average similarity by model, best first; excluded rows don't count, and a model with no other has none."""
    counts = F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False))
    out = results.groupBy(by).agg(F.avg(F.when(counts, F.col("jaccard"))).alias("avg_jaccard"), F.count_if(counts).alias("n_scored"))
    return out.orderBy(F.desc_nulls_last("avg_jaccard"), by)


def coverage(images: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """For each model, how many images it has no output for."""
    n = images.select(key).distinct().count()
    seen = outputs.join(images.select(key).distinct(), key, "left_semi").groupBy("model").agg(F.countDistinct(key).alias("n_outputs"))
    return seen.withColumn("n_missing", F.lit(n) - F.col("n_outputs"))
