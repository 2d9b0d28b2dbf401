"""Text recognition: files to pages, an engine over pages or whole files, and document rows."""

from __future__ import annotations

import base64
import json
import os
import struct
import subprocess
import tempfile
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.data_url import sniff
from ..sources.files import FileError, PageOptions, pages_of, read_file, run_tool
from ..sources.records import number_partitions, read_records, take
from .chat import Caller, RunOptions, envelope, render_blocks
from .layout import layout_text
from .models import vendor_of, with_cost
from .pages import FLAGS, SOURCES, USAGE, merge_pages
from .prompt import Prompt, load_prompt
from .providers import TRANSIENT_CODES, LlmOptions, Provider, aws_access, make_provider, post
from .retry import Ledger, Throttle, Transient, attempt, dealt_jobs, limiter, tasks_for
from .schema import DRAFT_07, ExternalSchema

ANALYSIS = "struct<image_source:string," + ",".join(f"{f}:boolean" for f in FLAGS) + ">"
PAGE_RESULT = f"text string, errors array<string>, analysis {ANALYSIS}, estimated_cost double, token_usage {USAGE}, error string"

#: Price of a page of the layout service, its polls and the wait between them.
LAYOUT_PRICE, POLLS, POLL_SECONDS = 0.004, 60, 5.0

#: Letters of the example page, seven rows of five pixels each.
GLYPHS = {"A": "01110 10001 10001 11111 10001 10001 10001", "E": "11111 10000 10000 11110 10000 10000 11111", "I": "01110 00100 00100 00100 00100 00100 01110", "L": "10000 10000 10000 10000 10000 10000 11111", "M": "10001 11011 10101 10101 10001 10001 10001", "O": "01110 10001 10001 10001 10001 10001 01110", "S": "01111 10000 10000 01110 00001 00001 11110", "T": "11111 00100 00100 00100 00100 00100 00100", "X": "10001 01010 00100 00100 00100 01010 10001"}


def drawn(*lines: tuple[str, int], width: int = 320) -> bytes:
    """A PNG image, black on white, of lines of GLYPHS, each with the pixels that a dot takes."""
    rows = []
    for text, scale in lines:
        rows += [bytes([255]) * width] * (2 * scale)
        for i in range(7):
            dots = "0".join(GLYPHS[c].split()[i] if c in GLYPHS else "000" for c in text)
            rows += [bytes(x for d in "00" + dots for x in [0 if d == "1" else 255] * scale).ljust(width, b"\xff")[:width]] * scale
    rows += [bytes([255]) * width] * 8

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


_EXAMPLE = {"full_markdown": "# A TITLE\n\nSOME TEXT", "analysis": {"image_source": "DIGITAL", **{f: False for f in FLAGS}}}
EXAMPLE_OUTPUT = json.dumps(_EXAMPLE)
EXAMPLE_INPUT = "data:image/png;base64," + base64.b64encode(drawn(("A TITLE", 4), ("SOME TEXT", 2))).decode()

#: The built-in prompt; any other may use the same bindings.
DEFAULT_PROMPT = {
    "developer": "Transcribe the page in the image as Markdown. Keep the reading order, headings, lists and tables; leave out nothing and add nothing. Then judge the image with the given flags.",
    "response_schema": {"description": "Replaced by the page schema."},
    "messages": [{"user": {"images": ["{{example_input_data_url}}"]}}, {"assistant": {"json": _EXAMPLE}}, {"user": {"images": ["{{page_data_url}}"]}}],
}


def page_schema() -> dict:
    """JSON Schema of a page: full_markdown and analysis."""
    flags = {f: {"type": "boolean", "description": f.replace("_", " ").capitalize() + "."} for f in FLAGS}
    analysis = {"type": "object", "description": "What the image is like.", "properties": {"image_source": {"type": "string", "enum": list(SOURCES), "description": "How the image was made."}, **flags}, "required": ["image_source", *flags], "additionalProperties": False}
    return {"$schema": DRAFT_07, "title": "OcrPage", "description": "A transcribed page.", "type": "object", "properties": {"full_markdown": {"type": "string", "description": "The page as Markdown."}, "analysis": analysis}, "required": ["full_markdown", "analysis"], "additionalProperties": False}


def page_result(text: str | None = None, errors: list[str] | None = None, analysis: dict | None = None, cost: float | None = None, usage: dict | None = None, error: str | None = None) -> tuple:
    return text, errors or [], analysis, cost, usage, error


def tesseract(mime: str, data: bytes) -> tuple:
    """Page engine: the tesseract tool reads the image from its input."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "page")
        with open(path, "wb") as f:
            f.write(data)
        out, warnings = run_tool("tesseract", path, "-", check_lines=False)
    return page_result(out.decode(errors="replace"), [w for w in warnings if "error" in w.lower()])


def pdftotext(content: bytes, options: PageOptions, password: str | None) -> tuple:
    """File engine: (status, text, errors, page_count, cost) of a PDF's own text; a form feed that ends it goes."""
    if sniff(content) != "application/pdf":
        raise FileError("pdftotext reads only PDF files")
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "in.pdf")
        with open(path, "wb") as f:
            f.write(content)
        argv = ["pdftotext", "-layout", *(["-l", str(options.max_pages)] if options.max_pages else []), *([] if options.include_page_breaks else ["-nopgbrk"]), *(["-opw", password] if password else []), path, "-"]
        out, warnings = run_tool(*argv)
    text = out.decode(errors="replace")
    return "ok", text.removesuffix("\f"), warnings, None, None


@dataclass
class LayoutService:
    """The page-analysis service, over HTTPS with a bearer token or AWS keys, or through a stub."""

    base_url: str | None = None
    region: str = "us-east-1"
    token: str | None = None

    def call(self, action: str, body: dict) -> dict:
        base = self.base_url or f"https://textract.{self.region}.amazonaws.com"
        headers, sign = aws_access(self.token or os.environ.get("AWS_BEARER_TOKEN"), self.region, "textract")
        return post(base, body, {"Content-Type": "application/x-amz-json-1.1", "X-Amz-Target": f"Textract.{action}", **headers}, 300, TRANSIENT_CODES["textract"], sign)

    @staticmethod
    def blocks(answer: dict) -> list[dict]:
        return [{"id": b.get("Id"), "block_type": b.get("BlockType"), "text": b.get("Text"), "children": [i for r in b.get("Relationships") or [] if r.get("Type") == "CHILD" for i in r.get("Ids") or []]} for b in answer.get("Blocks") or []]

    def page(self, mime: str, data: bytes) -> tuple:
        """Page engine; a call that fails is a failed page and isn't tried again."""
        try:
            answer = self.call("AnalyzeDocument", {"Document": {"Bytes": base64.b64encode(data).decode()}, "FeatureTypes": ["LAYOUT"]})
        except Exception as e:
            return page_result(errors=[str(e)])
        return page_result(layout_text(self.blocks(answer)), cost=LAYOUT_PRICE)

    def document(self, path: str, page_breaks: bool, sleep: Callable[[float], None] = time.sleep, take: Callable[[], None] | None = None) -> tuple:
        """File engine for s3:// paths: starts a job, polls it, and follows its pages of results. Each attempt of a call takes a permit."""
        bucket, _, key = path.removeprefix("s3://").partition("/")
        if not path.startswith("s3://") or not key:
            raise FileError(f"{path} is no s3://bucket/key")

        def tried(action: str, body: dict) -> dict:
            def call() -> dict:
                if take:
                    take()
                return self.call(action, body)

            done = attempt(call, sleep=sleep)
            if done.value is None:
                raise FileError("; ".join(done.errors))
            return done.value

        job = tried("StartDocumentAnalysis", {"DocumentLocation": {"S3Object": {"Bucket": bucket, "Name": key}}, "FeatureTypes": ["LAYOUT"]})["JobId"]
        for _ in range(POLLS):
            answer = tried("GetDocumentAnalysis", {"JobId": job})
            if answer.get("JobStatus") != "IN_PROGRESS":
                break
            sleep(POLL_SECONDS)
        if answer.get("JobStatus") not in ("SUCCEEDED", "PARTIAL_SUCCESS"):
            raise FileError(f"the analysis ended as {answer.get('JobStatus')}: {answer.get('StatusMessage') or ''}")
        pages, blocks = int((answer.get("DocumentMetadata") or {}).get("Pages") or 0), self.blocks(answer)
        warnings = [f"{w.get('ErrorCode')}: pages {w.get('Pages')}" for w in answer.get("Warnings") or []]
        status = "ok" if answer["JobStatus"] == "SUCCEEDED" else "incomplete"
        while answer.get("NextToken"):
            answer = tried("GetDocumentAnalysis", {"JobId": job, "NextToken": answer["NextToken"]})
            blocks += self.blocks(answer)
        return status, layout_text(blocks, page_breaks), warnings, pages, pages * LAYOUT_PRICE


def engine_kind(model: str) -> str:
    """Which engine a model name stands for; unknown names are models of the provider."""
    return model if model in ("pdftotext", "tesseract", "textract", "textract-async") else "llm"


def check_options(model: str, options: PageOptions) -> None:
    """Raises ValueError where an engine can't do what the options ask."""
    kind = engine_kind(model)
    if kind == "pdftotext" and options.rasterize:
        raise ValueError("pdftotext can't be used with rasterize")
    if kind == "tesseract" and not options.rasterize:
        raise ValueError("tesseract needs rasterize")
    if kind == "textract-async" and (options.rasterize or options.max_pages is not None):
        raise ValueError("textract-async can't be used with rasterize or max_pages")


def explode_pages(df: DataFrame, options: PageOptions) -> DataFrame:
    """Rows of pages: _seq, page_idx, mime_type, data, total_pages, warnings, error. A file without pages has one row with a null page_idx."""
    schema = "_seq long, page_idx int, mime_type string, data binary, total_pages long, warnings array<string>, error string"

    def run(frames):
        for pdf in frames:
            for seq, path, password, content in zip(pdf["_seq"], pdf["path"], pdf["password"], pdf["content"], strict=True):
                try:
                    found, total, warnings = pages_of(content if content is not None else read_file(path), options, password)
                    rows = [(seq, i, m, d, total, warnings, None) for i, (m, d) in enumerate(found)] or [(seq, None, None, None, total, warnings, None)]
                except (FileError, OSError, subprocess.SubprocessError) as e:
                    rows = [(seq, None, None, None, None, [], f"{path}: {e}")]
                # a page at a time, so that a long document doesn't fill a batch
                for row in rows:
                    yield pd.DataFrame([row], columns=["_seq", "page_idx", "mime_type", "data", "total_pages", "warnings", "error"])

    return df.select("_seq", "path", "password", "content").mapInPandas(run, schema)


@dataclass
class PageEngine:
    """Runs a page engine over page rows; pickled to workers."""

    engine: Any
    caller: Caller | None = None
    throttle: Ledger | Throttle | None = None

    def __call__(self, frames):
        bucket = self.throttle.bucket() if self.throttle else None
        for pdf in frames:
            rows = []
            if self.caller is not None:
                some = [d is not None for d in pdf["data"]]
                urls = [f"data:{m};base64,{base64.b64encode(d).decode()}" for m, d, s in zip(pdf["mime_type"], pdf["data"], some, strict=True) if s]
                done = iter(self.caller.rows([self.caller.rendered({"page_data_url": u, "example_output": EXAMPLE_OUTPUT, "example_input_data_url": EXAMPLE_INPUT}) for u in urls], bucket))
                for s in some:
                    if not s:
                        rows.append(page_result())
                        continue
                    status, errors, response, usage = next(done)
                    answer = json.loads(response) if status == "ok" else {}
                    rows.append(page_result(answer.get("full_markdown"), errors, answer.get("analysis"), None, usage))
            else:
                for mime, data in zip(pdf["mime_type"], pdf["data"], strict=True):
                    try:
                        if bucket and data is not None:
                            bucket.take()
                        rows.append(page_result() if data is None else self.engine(mime, data))
                    except (FileError, OSError, ValueError) as e:
                        rows.append(page_result(error=str(e)))
            found = pd.DataFrame(rows, columns=["text", "errors", "analysis", "estimated_cost", "token_usage", "_error"], index=pdf.index)
            out = pd.concat([pdf.drop(columns=["data", "mime_type"]), found], axis=1)
            out["error"] = out["error"].where(out["error"].notna(), out.pop("_error"))
            yield out


def ocr(source: DataFrame | str, model: str = "echo", provider: str | Provider = "echo", prompt: str | dict | Prompt | None = None, pages: PageOptions = PageOptions(), run: RunOptions = RunOptions(), options: LlmOptions = LlmOptions(), models: DataFrame | None = None, spark: SparkSession | None = None, id_col: str = "id", engine: Callable[[str, bytes], tuple] | None = None, service: LayoutService | None = None, with_analysis: bool = False) -> DataFrame:
    """Document rows of files: _seq, id, status, estimated_cost, token_usage, errors, passthrough_data, path, text, page_count and, if asked for, analysis.

    source has path, and may have password (empty: none) and content (binary;
    else workers open the path). A file or page that can't be read is a failed row. The layout engines
    make `jobs` calls a second at most where no limit is given. The only
    shuffles are that of the pages by document and the join of their results.
    """
    kind = "custom" if engine else engine_kind(model)
    if not engine:
        check_options(model, pages)
    if isinstance(source, str):
        df = read_records(spark or SparkSession.getActiveSession(), source)
    else:
        places = run.offset or run.limit is not None
        df = envelope(number_partitions(source) if places and "_seq" not in source.columns else source, id_col)
    if dict(df.dtypes).get("row") == "variant":
        df = df.withColumns({"path": F.variant_get("row", "$.path", "string"), "password": F.try_variant_get("row", "$.password", "string")}).drop("row")
    df = take(df, run.offset, run.limit)
    for name, type_ in (("password", "string"), ("content", "binary")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    df = df.withColumn("password", F.when(F.col("password") != "", F.col("password")))
    skip = F.coalesce("skip_processing", F.lit(False))
    work, service = df.where(~skip), service or LayoutService()
    asked = options.rate_limit or (f"{max(1, run.jobs)}/s" if kind in ("textract", "textract-async") else None)
    throttle = limiter(df.sparkSession, asked, min(run.jobs, df.sparkSession.sparkContext.defaultParallelism))
    dealt = dealt_jobs(run.jobs, tasks_for(df.sparkSession, run.jobs, throttle))
    slots = len(dealt)
    if kind in ("pdftotext", "textract-async"):

        def whole(frames):
            bucket = throttle.bucket() if throttle else None
            for pdf in frames:
                rows = []
                for path, password, content in zip(pdf["path"], pdf["password"], pdf["content"], strict=True):
                    try:
                        rows.append(pdftotext(content if content is not None else read_file(path), pages, password) if kind == "pdftotext" else service.document(path, pages.include_page_breaks, take=bucket.take if bucket else None))
                    except (FileError, OSError, ValueError, Transient) as e:
                        rows.append(("failed", None, [f"{path}: {e}"], None, None))
                found = pd.DataFrame(rows, columns=["status", "text", "errors", "page_count", "estimated_cost"], index=pdf.index)
                yield pd.concat([pdf[["_seq"]], found.assign(token_usage=None)], axis=1)

        files = work.select("_seq", "path", "password", "content")
        merged = (files.repartition(slots) if throttle else files).mapInPandas(whole, f"_seq long, status string, text string, errors array<string>, page_count long, estimated_cost double, token_usage {USAGE}")
    else:
        if kind == "llm":
            given = load_prompt(prompt or DEFAULT_PROMPT)
            given = replace(given, response_schema=ExternalSchema(page_schema()))
            given.check()
            if models is not None and options.vendor is None:
                options = replace(options, vendor=vendor_of(models, model))
            caller = Caller(make_provider(provider), model, page_schema(), options, dealt, None, render_blocks(given))
            worker = PageEngine(None, caller, throttle)
        else:
            worker = PageEngine(engine or {"tesseract": tesseract, "textract": service.page}[kind], None, throttle)
        found = explode_pages(work, pages).repartition(slots).mapInPandas(worker, f"_seq long, page_idx int, total_pages long, warnings array<string>, error string, {PAGE_RESULT.replace(', error string', '')}")
        if kind == "llm" and models is not None:
            found = with_cost(found.withColumn("model", F.lit(model)), models).drop("model")
        merged = merge_pages(found, ["_seq"], pages.include_page_breaks, pages.max_pages, with_analysis=True)
    if "analysis" not in merged.columns or not with_analysis:
        merged = merged.drop("analysis").withColumn("analysis", F.lit(None).cast(ANALYSIS))
    carried = df.select("_seq", "id", "path", "passthrough_data")
    columns = ["_seq", "id", "status", "estimated_cost", "token_usage", "errors", "passthrough_data", "path", "text", "page_count", "analysis"]
    done = carried.join(merged, "_seq").select(*columns)
    none = {"status": F.lit("skipped"), "estimated_cost": F.lit(None).cast("double"), "token_usage": F.lit(None).cast(USAGE), "errors": F.array().cast("array<string>"), "text": F.lit(None).cast("string"), "page_count": F.lit(None).cast("bigint"), "analysis": F.lit(None).cast(ANALYSIS)}
    skipped = df.where(skip).select("_seq", "id", "path", "passthrough_data", *(c.alias(n) for n, c in none.items())).select(*columns)
    return done.unionByName(skipped)


