"""The dimension of models: prices, and the cost of token usage."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = "model string, provider string, input_cost_per_token double, output_cost_per_token double"

#: Rows of a model table that are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def model_rows(info: dict) -> list[tuple]:
    """Rows of MODELS from a proxy's /model/info answer; absent prices are 0."""
    out = {}
    for m in info.get("data", []):
        details = m.get("model_info") or {}
        out[m["model_name"]] = (m["model_name"], details.get("litellm_provider"), float(details.get("input_cost_per_token") or 0), float(details.get("output_cost_per_token") or 0))
    return list(out.values())


def fetch_models(spark: SparkSession, base_url: str, api_key: str | None = None, timeout: float = 10) -> DataFrame:
    """The models of an OpenAI-compatible proxy; none if it can't be reached."""
    request = urllib.request.Request(base_url.rstrip("/") + "/model/info", headers={"Authorization": f"Bearer {api_key}"} if api_key else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            rows = model_rows(json.load(answer))
    except (OSError, ValueError, KeyError, TypeError):
        rows = []
    return spark.createDataFrame(rows, MODELS)


def vendor_of(models: DataFrame, model: str) -> str | None:
    """Who stands behind a model name, as the table says; null if it doesn't."""
    found = models.where(F.col("model") == model).select("provider").first()
    return found.provider if found else None


def cost(prompt_tokens: Column, completion_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Estimated cost; null without prices or usage, 0 for free models."""
    return prompt_tokens * input_price + completion_tokens * output_price


def with_cost(df: DataFrame, models: DataFrame, model: str = "model", usage: str = "token_usage") -> DataFrame:
    """Adds estimated_cost; unknown models have none. A model name that repeats counts once."""
    prices = models.dropDuplicates(["model"]).select(F.col("model").alias("_model"), "input_cost_per_token", "output_cost_per_token")
    small = models.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = df.join(F.broadcast(prices) if small else prices, df[model] == F.col("_model"), "left")
    u = F.col(usage)
    return out.withColumn("estimated_cost", cost(u["prompt_tokens"], u["completion_tokens"], F.col("input_cost_per_token"), F.col("output_cost_per_token"))).drop("_model", "input_cost_per_token", "output_cost_per_token")
