"""Record sources and sinks: JSONL and CSV with the fixed envelope, in input order."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_splits import count_csv, csv_records

#: Columns of the envelope; everything else is the user's.
ENVELOPE = ("id", "skip_processing", "passthrough_data")


def is_json(path: str) -> bool:
    """JSON or JSONL by the name; anything else is CSV."""
    return os.path.splitext(path)[1].lower() in (".json", ".jsonl")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path (not made yet) in the folder of spark.checkpoint.dir, which all machines share; without it in the warehouse on a single machine, and else ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    where = where or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spool(spark: SparkSession, stream=None) -> str:
    """Copies standard input to a file that all machines can read, named by its first byte that isn't blank: `{` is JSONL, else CSV.

    The input passes in blocks, of which one is held.
    """
    stream, head = stream or sys.stdin.buffer, b""
    while not head.strip() and (block := stream.read(1 << 20)):
        head += block
    if not head.strip():
        raise ValueError("the input is empty")
    path = scratch_path(spark, "stdin") + (".jsonl" if head.lstrip()[:1] == b"{" else ".csv")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    while head:
        out.write(bytearray(head))
        head = stream.read(1 << 20)
    out.close()
    return path


def number_rows(df: DataFrame, name: str = "_seq") -> DataFrame:
    """Adds the place of each row, from 0, in the order of the files and their parts.

    Two passes: counts of each part (a few numbers for each), then their sums are
    added to each row's place in its part. No row is moved. Only for frames that
    read files, before any shuffle.
    """
    marked = df.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_row"))
    parts = marked.groupBy("_file", "_start").agg(F.min("_row").alias("_low"), F.count("*").alias("_n")).collect()
    rows, total = [], 0
    for p in sorted(parts, key=lambda p: (p["_file"], p["_start"])):
        rows.append((p["_file"], p["_start"], p["_low"], total))
        total += p["_n"]
    if not rows:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    bases = df.sparkSession.createDataFrame(rows, "_file string, _start long, _low long, _base long")
    out = marked.join(F.broadcast(bases), ["_file", "_start"]).withColumn(name, F.col("_row") - F.col("_low") + F.col("_base"))
    return out.drop("_file", "_start", "_row", "_low", "_base")


def number_partitions(df: DataFrame, name: str = "_seq") -> DataFrame:
    """The same for any frame, in order of its partitions; the frame must give the same rows in the same places each time."""
    marked = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    parts = marked.groupBy("_part").agg(F.count("*").alias("_n")).collect()
    rows, total = [], 0
    for p in sorted(parts):
        rows.append((p["_part"], total))
        total += p["_n"]
    bases = df.sparkSession.createDataFrame(rows, "_part int, _base long")
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(bases), "_part").withColumn(name, within + F.col("_base")).drop("_part", "_row", "_base")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSONL file: _seq, id (JSON text), skip_processing, passthrough_data (JSON text) and row (VARIANT).

    A line that is no JSON object, or has no id, fails the run and is named.
    """
    lines = number_rows(spark.read.text(path))
    row = F.try_parse_json("value")
    bad = row.isNull() | ~F.schema_of_variant(row).startswith("OBJECT") | F.variant_get(row, "$.id", "variant").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a record with an id: "), F.col("value")))).otherwise(row)
    lines = lines.select("_seq", checked.cast("variant").alias("row"))
    skip = F.variant_get("row", "$.skip_processing", "variant")
    kind = F.schema_of_variant(skip)
    skip = F.when(kind.isin("BOOLEAN", "VOID") | skip.isNull(), F.variant_get("row", "$.skip_processing", "boolean")).otherwise(F.raise_error(F.lit("skip_processing must be true or false")).cast("boolean"))
    passed = F.variant_get("row", "$.passthrough_data", "variant")
    return lines.select("_seq", json_text(F.variant_get("row", "$.id", "variant")).alias("id"), skip.alias("skip_processing"), F.when(F.schema_of_variant(passed) != "VOID", F.to_json(passed)).alias("passthrough_data"), "row")


def json_text(value: Column) -> Column:
    """JSON text of a VARIANT, strings quoted; to_json of a bare string does the same."""
    return F.to_json(value)


def quoted(text: Column) -> Column:
    """JSON text of a string."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Rows of a CSV file with a header: _seq, the envelope, and the user's columns as strings.

    Empty cells are empty strings. A ragged row fails the run. `true` and `false` are accepted in
    skip_processing; passthrough_data stays a JSON string. Files are split. Quoted cells may hold line breaks, for
    which a first pass finds where records start (csv_splits); with line_breaks=False they may not, and there is none.
    """
    options = {"header": True, "inferSchema": False, "mode": "FAILFAST", "multiLine": line_breaks, "escape": '"', "nullValue": "\0", "emptyValue": ""}
    df = spark.read.options(**options).csv(path)
    if "id" not in df.columns:
        raise ValueError(f"{path}: no column id")
    texts = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]
    if line_breaks:
        cells = F.from_csv("record", ", ".join(f"`{c}` string" for c in df.columns), {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "inferSchema")})
        df = csv_records(spark, path).select("_seq", cells.alias("_cells")).select("_seq", "_cells.*").select("_seq", *texts)
    else:
        df = number_rows(df.select(texts))
    skip = F.lower(F.trim("skip_processing")) if "skip_processing" in df.columns else F.lit("")
    flag = F.when(skip == "true", True).when(skip == "false", False).when(skip != "", F.raise_error(F.lit("skip_processing must be true or false")).cast("boolean"))
    passed = F.when(F.col("passthrough_data") != "", quoted(F.col("passthrough_data"))) if "passthrough_data" in df.columns else F.lit(None).cast("string")
    user = [c for c in df.columns if c not in (*ENVELOPE, "_seq")]
    return df.select("_seq", quoted(F.col("id")).alias("id"), flag.alias("skip_processing"), passed.alias("passthrough_data"), *user)


def read_records(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    return read_jsonl(spark, path) if is_json(path) else read_csv(spark, path, line_breaks)


def count_records(spark: SparkSession, path: str) -> int:
    """Number of records (rows of a CSV, lines of a JSONL file)."""
    return spark.read.text(path).count() if is_json(path) else count_csv(spark, path)


def take(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of these places in the input; a filter, so nothing is sorted and it runs before all work."""
    out = df.where(F.col("_seq") >= offset) if offset else df
    return out if limit is None else out.where(F.col("_seq") < offset + limit)


def json_lines(df: DataFrame, optional: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    """One compact JSON object for each row: `optional` keys are left out where null, others are written as null; `raw` columns hold JSON text."""
    parts = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in raw:
            value = c
        else:
            whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
            value = F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
        key = F.lit(f"{__import__('json').dumps(name)}:")
        parts.append(F.concat(key, value) if name in optional else F.concat(key, F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def write_jsonl(df: DataFrame, path: str, optional: tuple[str, ...] = (), raw: tuple[str, ...] = (), single: bool = False, order: str | None = None) -> None:
    """Writes rows as JSON lines; in order of a column if it is named (dropped), in one file only if asked."""
    out = df
    if order:
        out = out.repartition(1).sortWithinPartitions(order) if single else out.orderBy(order)
    elif single:
        out = out.coalesce(1)
    columns = out.drop(order) if order else out
    out.select(json_lines(columns, optional, raw).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def print_csv(df: DataFrame) -> None:
    """Rows as CSV on standard output, a partition at a time."""
    import csv

    to = csv.writer(sys.stdout, lineterminator="\n")
    to.writerow(df.columns)
    for row in df.toLocalIterator():
        to.writerow("" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row)


def flat_rows(df: DataFrame) -> DataFrame:
    """The CSV form of page results: id raw if it is a string, errors joined by a blank line or null, then path and text."""
    raw = F.when(F.col("id").startswith('"'), F.from_json(F.concat(F.lit("["), F.col("id"), F.lit("]")), "array<string>")[0]).otherwise(F.col("id"))
    return df.select(raw.alias("id"), "status", F.when(F.size("errors") > 0, F.array_join("errors", "\n\n")).alias("errors"), "path", "text")


def export_text(df: DataFrame, id_col: str, key: str, new_key: str, pattern: str) -> DataFrame:
    """Writes column `key` of each row to the file `pattern` (with {id}) and replaces it by the path.

    Rows where it is null pass with a null path. Files are written whole before they
    get their names, so a task that runs again does no harm. The folder must be
    shared by all machines.
    """
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name != key]
    schema = T.StructType([*kept, T.StructField(new_key, T.StringType())])

    def run(frames):
        folders: set[str] = set()
        for pdf in frames:
            paths = []
            for i, text in zip(pdf[id_col], pdf[key], strict=True):
                if text is None:
                    paths.append(None)
                    continue
                path = pattern.format(**{"id": i, id_col: i})
                if (folder := os.path.dirname(path) or ".") not in folders:
                    os.makedirs(folder, exist_ok=True)
                    folders.add(folder)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, path)
                paths.append(path)
            yield pdf.drop(columns=[key]).assign(**{new_key: paths})

    return df.mapInPandas(run, schema)
