"""Files as pages: images by magic bytes, PDFs by external tools where they are installed."""

from __future__ import annotations

import glob
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.data_url import PAGE_IMAGES, sniff
from ..functions.text import TOO_MANY_PAGES

#: Bytes of files that a task hands on at once.
READ_BYTES = 4 << 20


class FileError(ValueError):
    """A file that can't be turned into pages; its row fails, not the run."""


@dataclass(frozen=True)
class PageOptions:
    rasterize: bool = False
    rasterize_dpi: int = 300
    max_pages: int | None = None
    include_page_breaks: bool = False


def attach_files(df: DataFrame, path: Column, files: DataFrame | None = None, name: str = "content") -> DataFrame:
    """Adds the content of each row's file; a missing file fails the run.

    files: (path, content), read in any way, and joined. Without it each row's file is opened by the worker that has the row,
    which must have it mounted: no folder is listed, and no content shuffled.
    """
    if files is None:
        return opened(df.withColumn("_wanted", path), {"_wanted": name}, blank=False)
    f = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    out = df.withColumn("_wanted", path).join(f, F.col("_wanted") == F.col("_path"), "left")
    missing = F.raise_error(F.concat(F.lit("no such file: "), F.coalesce("_wanted", F.lit("null"))))
    found = F.when(F.col("_path").isNull(), missing.cast("binary")).otherwise(F.col("_content"))
    return out.withColumn(name, found).drop("_wanted", "_path", "_content")


def opened(df: DataFrame, contents: dict[str, str], blank: bool) -> DataFrame:
    """Puts the content of files in place of columns of paths, READ_BYTES or a row at a time; with `blank` a null or empty path has none."""
    kept = [c for c in df.columns if c not in contents and c not in contents.values()]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.BinaryType()) for c in contents.values())])

    def content(path: str | None) -> bytes | None:
        if blank and not path:
            return None
        try:
            return read_file(path or "null")
        except FileNotFoundError as e:
            raise FileError(f"no such file: {path or 'null'}") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for paths in zip(*(c.to_pylist() for c in batch.columns[len(kept) :]), strict=True):
                held.append([content(p) for p in paths])
                size += sum(len(x) for x in held[-1] if x is not None)
                if size > READ_BYTES:
                    yield made(batch, start, held)
                    start, held, size = start + len(held), [], 0
            if held:
                yield made(batch, start, held)

    def made(batch: pa.RecordBatch, start: int, held: list[list[bytes | None]]) -> pa.RecordBatch:
        own = batch.slice(start, len(held)).columns[: len(kept)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.binary()) for x in zip(*held, strict=True))], names=schema.names)

    return df.select(*kept, *contents).mapInArrow(run, schema)


def read_file(path: str) -> bytes:
    with open(path.removeprefix("file://"), "rb") as f:
        return f.read()


def _bad_line(line: str) -> bool:
    return bool(re.search("error", line, re.I)) and not re.search("error: xref num", line, re.I)


def run_tool(*argv: str, check_lines: bool = True) -> tuple[bytes, list[str]]:
    """(output, warnings) of an external tool; raises FileError if it is missing or fails."""
    if not shutil.which(argv[0]):
        raise FileError(f"{argv[0]} is not installed")
    done = subprocess.run(argv, capture_output=True)
    lines = [x.strip() for x in done.stderr.decode(errors="replace").split("\n") if x.strip()]
    if done.returncode or (check_lines and any(map(_bad_line, lines))):
        raise FileError(f"{argv[0]} failed with {done.returncode}: {' '.join(lines)[:2000]}")
    return done.stdout, lines


def page_count(pdf: str) -> int:
    out, _ = run_tool("pdfinfo", pdf)
    found = dict(x.split(":", 1) for x in out.decode(errors="replace").splitlines() if ":" in x)
    try:
        return int(found["Pages"])
    except (KeyError, ValueError) as e:
        raise FileError("pdfinfo gives no page count") from e


def too_many(max_pages: int | None, total: int) -> str | None:
    if max_pages is not None and total > max_pages:
        return TOO_MANY_PAGES % (max_pages, total)
    return None


def pages_of(content: bytes, options: PageOptions, password: str | None = None) -> tuple[list[tuple[str, bytes]], int, list[str]]:
    """((MIME type, bytes) of each page, number of pages, warnings) of a file; pages in numeric order."""
    kind = sniff(content)
    if kind in PAGE_IMAGES:
        return [(kind, content)], 1, []
    if kind != "application/pdf":
        raise FileError(f"unsupported file type {kind or 'unknown'}")
    with tempfile.TemporaryDirectory() as folder:
        pdf = os.path.join(folder, "in.pdf")
        with open(pdf, "wb") as f:
            f.write(content)
        total = page_count(pdf)
        last = total if options.max_pages is None else min(total, options.max_pages)
        if options.rasterize or password:
            made, kind = os.path.join(folder, "page"), "image/png"
            argv = ["pdftocairo", "-png", "-r", str(options.rasterize_dpi), "-l", str(last), *(["-opw", password] if password else []), pdf, made]
        else:
            made, kind = os.path.join(folder, "page-%d.pdf"), "application/pdf"
            argv = ["pdfseparate", "-l", str(last), pdf, made]
        out, warnings = run_tool(*argv)
        found = [p for p in glob.glob(os.path.join(folder, "page*")) if re.search(r"(\d+)\.\w+$", p)]
        found.sort(key=lambda p: int(re.search(r"(\d+)\.\w+$", p)[1]))  # type: ignore[index]
        warnings = [x.strip() for x in out.decode(errors="replace").split("\n") if x.strip()] + warnings
        return [(kind, read_file(p)) for p in found[:last]], total, warnings
