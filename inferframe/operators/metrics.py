"""Counters of a run and its failure gate."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SUCCESS = ("ok", "skipped")


class FailureRateError(RuntimeError):
    """More rows failed than the run allows."""


def is_success(status: Column) -> Column:
    return status.isin(*SUCCESS)


def counter_columns(df: DataFrame) -> list[Column]:
    """Aggregates of a run; columns that the frame lacks count as null."""
    good = is_success(F.col("status"))
    cost = F.col("estimated_cost") if "estimated_cost" in df.columns else F.lit(None).cast("double")
    usage = "token_usage" in df.columns
    return [
        F.count("*").alias("total"),
        F.count_if(~good).alias("failures"),
        F.coalesce(F.sum(F.when(good, F.size("errors"))), F.lit(0)).cast("bigint").alias("non_fatal_errors"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("estimated_cost"),
        F.coalesce(F.sum(F.col("token_usage.prompt_tokens") if usage else F.lit(0)), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(F.sum(F.col("token_usage.completion_tokens") if usage else F.lit(0)), F.lit(0)).cast("bigint").alias("completion_tokens"),
    ]


def run_counters(df: DataFrame) -> DataFrame:
    """One row of counters of result rows."""
    return df.agg(*counter_columns(df))


def observed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The frame, and counters that are filled while it is written, so that nothing runs twice."""
    seen = Observation(name)
    return df.observe(seen, *counter_columns(df)), seen


def gate_column(failures: Column, total: Column, allowed: float) -> Column:
    """Whether the failure rate, in single precision, is above the allowed one; without rows it isn't."""
    rate = (failures.cast("double") / F.nullif(total, F.lit(0))).cast("float")
    return F.coalesce(rate > F.lit(allowed).cast("float"), F.lit(False))


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


@dataclass
class Summary:
    total: int
    failures: int
    non_fatal_errors: int = 0
    estimated_cost: float = 0.0
    prompt_tokens: int = 0
    completion_tokens: int = 0

    @classmethod
    def of(cls, counters: dict) -> Summary:
        return cls(**{k: counters[k] or 0 for k in cls.__dataclass_fields__})

    def too_many_failures(self, allowed: float) -> bool:
        return bool(self.total) and _single(self.failures / self.total) > _single(allowed)

    def lines(self) -> list[str]:
        """The summary as text; zeros are left out."""
        out = []
        if self.non_fatal_errors:
            out.append(f"{self.non_fatal_errors} non-fatal errors")
        if self.failures:
            out.append(f"{self.failures} of {self.total} failed")
        if self.prompt_tokens or self.completion_tokens:
            out.append(f"tokens: {self.prompt_tokens} in, {self.completion_tokens} out")
        if self.estimated_cost:
            out.append(f"estimated cost: ${self.estimated_cost:.4f}")
        return out

    def check(self, allowed: float = 0.01) -> None:
        """Raises FailureRateError above the allowed failure rate; call it when the output is written."""
        if self.too_many_failures(allowed):
            raise FailureRateError(f"{self.failures} of {self.total} rows failed; {allowed:g} are allowed")
