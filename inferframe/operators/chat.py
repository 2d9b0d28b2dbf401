"""Runs a prompt over every row of a table."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Generator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import template as tpl
from ..sources.files import read_file
from ..sources.records import ENVELOPE, discard, flat_rows, json_lines, number_partitions, print_csv, quoted, read_records, scratch_path, take, write_csv, write_jsonl
from .metrics import Summary, run_counters
from .models import vendor_of, with_cost
from .pages import USAGE
from .prompt import Prompt, last_user_text, load_prompt, render_columns
from .providers import Completion, EchoProvider, LlmOptions, Provider, echo_problem, make_provider
from .retry import Bucket, Fatal, LeasedBucket, Ledger, Outcome, Throttle, Transient, Waits, attempts, dealt_jobs, limiter, own_jobs, tasks_for
from .schema import ExternalSchema, RecursiveSchema, check_supported, fits_schema, is_valid, problems, to_json_schema

RESULT = f"status string, errors array<string>, response string, token_usage {USAGE}"

#: Keys that a result record leaves out where they are null; JSON text that it holds as such.
OPTIONAL = ("estimated_cost", "token_usage", "passthrough_data", "response")
RAW = ("id", "passthrough_data", "response")


@dataclass(frozen=True)
class RunOptions:
    jobs: int = 8
    offset: int = 0
    limit: int | None = None
    allow_reordering: bool = False
    allowed_failure_rate: float = 0.01


def envelope(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A table as records: adds what is missing of _seq, id (JSON text), skip_processing and passthrough_data (JSON text)."""
    out = df
    if id_col != "id":
        out = out.withColumn("id", F.col(id_col))
    if "id" not in out.columns:
        raise ValueError("no column id")
    kind = dict(out.dtypes)["id"]
    if "_seq" not in out.columns:
        out = out.withColumn("_seq", F.monotonically_increasing_id())
    text = quoted(F.col("id")) if kind == "string" else F.to_json(F.array("id"))
    out = out.withColumn("id", text if kind == "string" else F.substring(text, F.lit(2), F.length(text) - 2))
    if "skip_processing" not in out.columns:
        out = out.withColumn("skip_processing", F.lit(False))
    if "passthrough_data" not in out.columns:
        out = out.withColumn("passthrough_data", F.lit(None).cast("string"))
    elif dict(out.dtypes)["passthrough_data"] != "string":
        out = out.withColumn("passthrough_data", F.to_json("passthrough_data"))
    return out


def bindings(df: DataFrame) -> tpl.Bindings:
    """Template variables of a table: its columns but for the envelope, or the fields of a VARIANT column `row`."""
    types = dict(df.dtypes)
    if types.get("row") == "variant":

        def of_row(path: tuple[str, ...]) -> tuple[Column, Column]:
            if not path or path[0] in ENVELOPE:
                return F.lit(None).cast("string"), F.lit(None).cast("string")
            value = F.try_variant_get("row", "$" + "".join(f"['{p}']" for p in path), "variant")
            null = F.schema_of_variant(value) == "VOID"
            nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
            return F.when(nested, F.to_json(value)).when(~null, F.try_variant_get("row", "$" + "".join(f"['{p}']" for p in path), "string")), F.when(null, "null").otherwise(F.to_json(value))

        return of_row

    def of_columns(path: tuple[str, ...]) -> tuple[Column, Column]:
        none = F.lit(None).cast("string")
        if not path or path[0] in ENVELOPE or path[0].startswith("_") or path[0] not in types:
            return none, none
        value = F.col(f"`{path[0]}`")
        kind = types[path[0]]
        for name in path[1:]:
            if not kind.startswith(("struct", "map")):
                return none, none
            value, kind = value[name], ""
        if len(path) > 1:
            return value.cast("string"), F.to_json(F.struct(value.alias("v")))
        if kind.startswith(("struct", "map", "array")):
            return F.to_json(value), F.to_json(value)
        if kind == "string":
            return value, quoted(value)
        return value.cast("string"), F.when(F.lit(kind in ("date", "binary")) | F.lit(kind.startswith("timestamp")), quoted(value.cast("string"))).otherwise(value.cast("string"))

    return of_columns


def _skipped(df: DataFrame, carried: list[str]) -> DataFrame:
    none = {"status": F.lit("skipped"), "errors": F.array().cast("array<string>"), "response": F.lit(None).cast("string"), "token_usage": F.lit(None).cast(USAGE)}
    return df.select(*carried, *(c.alias(n) for n, c in none.items()))


def echo_results(df: DataFrame, prompt: Prompt, files: tpl.Files | None = None) -> DataFrame:
    """Result columns of the echo provider as Spark columns only: status, errors, response (JSON text), token_usage."""
    problem = echo_problem(prompt.response_schema)
    rendered = render_columns(prompt, bindings(df), files)
    text = last_user_text(rendered["messages"])
    skip = F.coalesce("skip_processing", F.lit(False))
    failed = F.lit(problem).cast("string") if problem else F.when(text.isNull(), "no user message has a text")
    ok = ~skip & failed.isNull()
    return df.withColumns(
        {
            "status": F.when(skip, "skipped").when(ok, "ok").otherwise("failed"),
            "errors": F.when(~skip & failed.isNotNull(), F.array(failed)).otherwise(F.array().cast("array<string>")),
            "response": F.when(ok, F.concat(F.lit('{"echo":'), quoted(text), F.lit("}"))),
            "token_usage": F.when(ok, F.struct(F.lit(0).cast("bigint").alias("prompt_tokens"), F.lit(0).cast("bigint").alias("completion_tokens"))),
        }
    )


@dataclass
class Caller:
    """What a worker needs for its rows; pickled."""

    provider: Provider
    model: str
    schema: dict
    options: LlmOptions
    jobs: tuple[int, ...] | int
    throttle: Ledger | Throttle | None = None
    rendered: Callable[[dict], dict] | None = None
    sleep: Callable[[float], None] | None = field(default=None)

    def started(self, pool: ThreadPoolExecutor, waits: Waits, prompts: list[dict], bucket: Bucket | LeasedBucket | None) -> list[Future]:
        """Calls of each prompt, in order: (status, errors, response, token usage). One that waits for its next attempt leaves its place in the pool to others."""

        def steps(prompt: dict) -> Generator[float, None, Outcome]:
            def call() -> Completion:
                if bucket:
                    bucket.take()
                done = self.provider.complete(self.model, prompt, self.schema, self.options)
                if found := problems(done.response, self.schema):
                    raise Transient(f"the response doesn't fit the schema: {'; '.join(found[:5])}")
                return done

            return attempts(call)

        def result(outcome: Outcome) -> tuple:
            if outcome.kind not in ("ok", "recovered"):
                return "failed", outcome.errors, None, None
            c = outcome.value
            usage = None if c.prompt_tokens is None or c.completion_tokens is None else {"prompt_tokens": c.prompt_tokens, "completion_tokens": c.completion_tokens}
            return "ok", outcome.errors, json.dumps(c.response, ensure_ascii=False, separators=(",", ":")), usage

        def proceed(tries: Generator[float, None, Outcome], found: Future) -> None:
            try:
                wait = next(tries)
                while self.sleep:
                    self.sleep(wait)
                    wait = next(tries)
            except StopIteration as done:
                found.set_result(result(done.value))
            except BaseException as e:  # the row's reader raises it
                found.set_exception(e)
            else:
                waits.add(wait, lambda: pool.submit(proceed, tries, found))

        def start(prompt: dict) -> Future:
            found: Future = Future()
            pool.submit(proceed, steps(prompt), found)
            return found

        return [start(p) for p in prompts]

    def rows(self, prompts: list[dict], bucket: Bucket | LeasedBucket | None) -> list[tuple]:
        with ThreadPoolExecutor(own_jobs(self.jobs)) as pool, Waits() as waits:
            return [call.result() for call in self.started(pool, waits, prompts, bucket)]

    def __call__(self, frames):
        """For mapInPandas over frames with a column `prompt` (JSON text); the next frame's calls fill the pool while the last of one are awaited."""
        bucket = self.throttle.bucket() if self.throttle else None

        def finished(pdf: pd.DataFrame, calls: list[Future]) -> pd.DataFrame:
            found = pd.DataFrame([c.result() for c in calls], columns=["status", "errors", "response", "token_usage"], index=pdf.index)
            return pd.concat([pdf.drop(columns=["prompt"]), found], axis=1)

        with ThreadPoolExecutor(own_jobs(self.jobs)) as pool, Waits() as waits:
            before: tuple[pd.DataFrame, list[Future]] | None = None
            for pdf in frames:
                prompts = [json.loads(p) for p in pdf["prompt"]]
                calls = self.started(pool, waits, [self.rendered(p) for p in prompts] if self.rendered else prompts, bucket)
                if before:
                    yield finished(*before)
                before = pdf, calls
            if before:
                yield finished(*before)


def render_blocks(prompt: Prompt) -> Callable[[dict], dict]:
    """For prompts with blocks: renders a row's bindings in the worker."""
    def run(row: dict) -> dict:
        def f(text: str) -> str:
            return tpl.render(text, row, read_file)

        messages = [{"role": m.role, "text": None if m.text is None else f(m.text), "images": [f(i) for i in m.images], "json": json.dumps(tpl.render_json(m.json, f), ensure_ascii=False) if m.role == "assistant" else None} for m in prompt.messages]
        return {"developer": None if prompt.developer is None else f(prompt.developer), "messages": messages}

    return run


def provider_results(df: DataFrame, prompt: Prompt, provider: Provider, model: str, options: LlmOptions = LlmOptions(), jobs: int = 8, partitions: int | None = None, files: tpl.Files | None = None) -> DataFrame:
    """Result columns of any provider, called by Arrow batches of rows that aren't skipped, `jobs` at a time in all, dealt exactly to the tasks.

    A rate limit holds for all tasks together (retry.limiter).
    The calls are neither duplicated nor moved by the optimizer; write the result before
    aggregating it, since running the plan again would call again.
    """
    prompt.check()
    spark = df.sparkSession
    blocks = any(map(tpl.has_blocks, prompt.templates()))
    skip = F.coalesce("skip_processing", F.lit(False))
    carried = [c for c in ("_seq", "id", "passthrough_data") if c in df.columns]
    if blocks:
        user = [c for c in df.columns if c not in (*ENVELOPE, "_seq")]
        as_json = F.to_json("row") if dict(df.dtypes).get("row") == "variant" else F.to_json(F.struct(*(F.col(f"`{c}`") for c in user)), {"ignoreNullFields": "false"})
    else:
        as_json = F.to_json(render_columns(prompt, bindings(df), files), {"ignoreNullFields": "false"})
    limit = limiter(spark, options.rate_limit, min(jobs, spark.sparkContext.defaultParallelism))
    dealt = dealt_jobs(jobs, partitions or tasks_for(spark, jobs, limit))
    work = df.where(~skip).select(*carried, as_json.alias("prompt")).repartition(len(dealt))
    caller = Caller(provider, model, to_json_schema(prompt.response_schema), options, dealt, limit, render_blocks(prompt) if blocks else None)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*carried).schema.fields)
    return work.mapInPandas(caller, f"{kept}, {RESULT}").unionByName(_skipped(df.where(skip), carried))


def chat(source: DataFrame | str, prompt: str | dict | Prompt, provider: str | Provider = "echo", model: str = "echo", run: RunOptions = RunOptions(), options: LlmOptions = LlmOptions(), models: DataFrame | None = None, spark: SparkSession | None = None, id_col: str = "id", files: tpl.Files | None = None) -> DataFrame:
    """Result rows of a prompt over a table or file: _seq, id, status, estimated_cost, token_usage, errors, passthrough_data, response.

    id, passthrough_data and response are JSON text. Rows with skip_processing
    are not rendered. A row's failure is its status; an input or a template that
    can't be read fails the run.
    """
    prompt, provider = load_prompt(prompt), make_provider(provider)
    prompt.check()
    if models is not None and options.vendor is None:
        options = replace(options, vendor=vendor_of(models, model))
    if isinstance(source, str):
        df = read_records(spark or SparkSession.getActiveSession(), source)
    else:
        places = run.offset or run.limit is not None
        df = envelope(number_partitions(source) if places and "_seq" not in source.columns else source, id_col)
    df = take(df, run.offset, run.limit)
    if isinstance(provider, EchoProvider) and not any(map(tpl.has_blocks, prompt.templates())):
        out = echo_results(df, prompt, files)
    else:
        if isinstance(provider, EchoProvider) and (problem := echo_problem(prompt.response_schema)):
            provider = Broken(problem)
        out = provider_results(df, prompt, provider, model, options, run.jobs, files=files)
    out = out.withColumn("model", F.lit(model))
    out = with_cost(out, models) if models is not None else out.withColumn("estimated_cost", F.lit(None).cast("double"))
    return out.select("_seq", "id", "status", "estimated_cost", "token_usage", "errors", "passthrough_data", "response")


@dataclass
class Broken:
    """A provider that always fails, with a reason."""

    reason: str
    name: str = "broken"

    def complete(self, model: str, prompt: dict, schema: dict, options: LlmOptions) -> Completion:
        raise Fatal(self.reason)


class ResultsKept(RuntimeError):
    """Results were made but not all written; they lie in `path`, from which finish_results goes on without a new call."""

    def __init__(self, path: str, reason: BaseException):
        super().__init__(f"the results are kept in {path}; go on from there, no call has to be made again: {reason}")
        self.path = path


def in_order(rows: DataFrame, order: str = "_seq") -> DataFrame:
    """Rows in the order of a column of numbers, over as many partitions as now.

    Where the numbers are dense, as those of records are, each partition takes a range of them, and nothing is
    sampled: one pass for their bounds, which reads that column alone. Else Spark's sort.
    """
    low, high, n = rows.agg(F.min(order), F.max(order), F.count(order)).first()
    if not n or high - low >= 4 * n:
        return rows.orderBy(order)
    parts = min(n, max(1, rows.rdd.getNumPartitions()))
    width = -(-(high - low + 1) // parts)
    part = F.coalesce(F.floor((F.col(order) - low) / width), F.lit(0)).cast("int")
    return rows.withColumn("_part", part).repartitionById(parts, "_part").drop("_part").sortWithinPartitions(order)


def finish_results(spark: SparkSession, path: str, out: str | None, run: RunOptions = RunOptions(), single: bool = False, csv: bool = False) -> Summary:
    """Counts the results in the scratch folder `path` and writes them; then the folder goes.

    As JSON lines, or with `csv` in the flat form, in input order unless reordering is allowed; to standard output
    without `out`. If that fails, ResultsKept names the folder, which stays.
    """
    try:
        rows = spark.read.parquet(path)
        ordered = rows if run.allow_reordering or "_seq" not in rows.columns else in_order(rows)
        ordered = ordered.coalesce(1) if single and out is not None else ordered
        flat = flat_rows(ordered) if csv else ordered.drop("_seq")
        if out is not None:
            write_csv(flat, out) if csv else write_jsonl(flat, out, OPTIONAL, RAW)
        elif csv:
            print_csv(flat)
        else:
            for line in flat.select(json_lines(flat, OPTIONAL, RAW).alias("line")).toLocalIterator():
                print(line.line)
        summary = Summary.of(run_counters(rows).first().asDict())
    except Exception as e:
        raise ResultsKept(path, e) from e
    discard(spark, path)
    return summary


def write_results(results: DataFrame, out: str | None, run: RunOptions = RunOptions(), single: bool = False, csv: bool = False) -> Summary:
    """Makes the result rows once: they go to the shared folder as they come, and finish_results does the rest from there.

    So a lost executor costs its own unfinished rows only.
    """
    spark, path = results.sparkSession, scratch_path(results.sparkSession, "results")
    results.write.parquet(path)
    return finish_results(spark, path, out, run, single, csv)


def run_and_write(results: DataFrame, out: str | None, run: RunOptions = RunOptions(), single: bool = False, csv: bool = False) -> Summary:
    """write_results, and then the failure gate."""
    summary = write_results(results, out, run, single, csv)
    summary.check(run.allowed_failure_rate)
    return summary


def validated(df: DataFrame, text: str, schema) -> DataFrame:
    """Adds `fits`: whether a column of JSON text parses and fits a response schema; in SQL functions, but for a JSON Schema that refers to itself."""
    if isinstance(schema, ExternalSchema):
        document = schema.document
        check_supported(document)
        with contextlib.suppress(RecursiveSchema):
            return df.withColumn("fits", fits_schema(F.try_parse_json(F.col(text)), document))

        @F.pandas_udf("boolean")
        def fits(texts: pd.Series) -> pd.Series:
            def one(t):
                try:
                    return t is not None and not problems(json.loads(t), document)
                except ValueError:
                    return False

            return texts.map(one)

        return df.withColumn("fits", fits(F.col(text)))
    return df.withColumn("fits", is_valid(F.try_parse_json(F.col(text)), schema))
