import base64
import json
import random
import os
import shutil
import sys
import time
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inferframe.cli import main
from inferframe.operators import benchmark, layout, models, ocr, pages, similarity
from inferframe.operators.chat import RunOptions
from inferframe.operators.prompt import load_prompt
from inferframe.operators.providers import LlmOptions, split_data_url
from inferframe.operators.schema_export import TYPES, schema_for
from inferframe.sources.files import FileError, PageOptions, pages_of, run_tool, too_many
from inferframe.streaming.drop_folder import watch_folder

# workers can't import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PNG, JPG = b"\x89PNG\r\n\x1a\n" + b"p" * 20, b"\xff\xd8\xff" + b"j" * 20
PAGE = "d int, page_idx int, text string, errors array<string>, estimated_cost double, token_usage struct<prompt_tokens:bigint,completion_tokens:bigint>, total_pages bigint, warnings array<string>, error string"


def test_merge_statuses(spark):
    rows = [
        (1, 1, "b", ["x"], 0.5, (1, 2), 2, ["w"], None), (1, 0, "a", [], 0.25, (3, 4), 2, ["w"], None),  # ok, whole
        (2, 0, "a", [], None, None, 2, None, None), (2, 1, None, ["bad"], 9.0, (9, 9), 2, None, None),  # one page failed
        (3, 0, None, ["bad"], None, None, 1, None, None),  # all failed
        (4, 0, "a", [], 0.0, (0, 0), 5, None, None),  # more pages than asked for
        (5, None, None, [], None, None, 0, None, None),  # no pages
        (6, None, None, [], None, None, None, [], "can't read"),  # no document
        (7, 10, "k", [], None, None, 11, None, None), (7, 2, "c", [], None, None, 11, None, None), *[(7, i, str(i), [], None, None, 11, None, None) for i in (0, 1, 3, 4, 5, 6, 7, 8, 9)],
    ]
    got = {r.d: r for r in pages.merge_pages(spark.createDataFrame(rows, PAGE), ["d"]).collect()}
    assert (got[1].status, got[1].text, got[1].errors, got[1].estimated_cost, tuple(got[1].token_usage), got[1].page_count) == ("ok", "a\n\nb", ["w", "x"], 0.75, (4, 6), 2)
    assert (got[2].status, got[2].text, got[2].errors, got[2].estimated_cost, got[2].token_usage) == ("incomplete", "a\n\n**COULD_NOT_OCR_PAGE**", ["bad"], None, None)
    assert (got[3].status, got[3].text, got[3].page_count) == ("failed", None, 1)
    assert (got[4].status, got[4].estimated_cost, got[4].token_usage) == ("ok", None, None)
    assert (got[5].status, got[5].text, got[5].page_count) == ("ok", None, 0)
    assert (got[6].status, got[6].errors, got[6].page_count) == ("failed", ["can't read"], None)
    assert got[7].text == "\n\n".join(["0", "1", "c", "3", "4", "5", "6", "7", "8", "9", "k"])
    capped = {r.d: r for r in pages.merge_pages(spark.createDataFrame(rows, PAGE), ["d"], include_page_breaks=True, max_pages=1).collect()}
    assert capped[4].status == "incomplete" and capped[4].errors == ["Only 1/5 pages processed (because of --max-pages)"] and capped[1].text == "a\n\f\nb"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab é", max_size=4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_split_then_merge(docs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, "\n\n".join(d)) for i, d in enumerate(docs)], "d int, whole string")
    split = pages.split_pages(df, "whole", "\n\n", "text").withColumn("errors", F.array().cast("array<string>"))
    assert {r.d: r.text for r in pages.merge_pages(split, ["d"]).collect()} == {i: "\n\n".join(d) for i, d in enumerate(docs)}


def test_analysis(spark):
    def analysis(source, **flags):
        return (source, *(flags.get(f, False) for f in pages.FLAGS))

    rows = [(1, "t", analysis("DIGITAL")), (1, "t", analysis("SCAN", contains_faint_text=True)), (1, None, analysis("PHOTO_OR_VIDEO", glare_on_some_text=True)), (2, "t", None), (3, "t", analysis("DIGITAL", background_is_noisy=True))]
    df = spark.createDataFrame(rows, f"d int, text string, analysis {ocr.ANALYSIS}")
    got = {r.d: r for r in df.groupBy("d").agg(*pages.analysis_columns()).collect()}
    assert (got[1].image_source, got[1].contains_faint_text, got[1].glare_on_some_text) == ("SCAN", True, False) and got[2].image_source is None
    flagged = df.select("d", pages.is_flagged(F.col("analysis")).alias("f")).collect()
    assert [r.f for r in flagged] == [False, True, True, False, False]


def test_files():
    assert pages_of(PNG, PageOptions()) == ([("image/png", PNG)], 1, [])
    with pytest.raises(FileError, match="tiff"):
        pages_of(b"II*\0", PageOptions())
    with pytest.raises(FileError, match="unknown"):
        pages_of(b"hello", PageOptions())
    with pytest.raises(FileError, match="not installed"):
        run_tool("no-such-tool-here")
    with pytest.raises(FileError):
        run_tool("sh", "-c", "echo 'Error: x' >&2")
    assert run_tool("sh", "-c", "echo 'error: xref num 2' >&2; echo out")[0] == b"out\n"
    assert too_many(1, 2) == "Only 1/2 pages processed (because of --max-pages)" and too_many(2, 2) is None and too_many(None, 9) is None


def upper_engine(mime, data):
    if data.endswith(b"j"):
        raise FileError("no jpeg")
    return ocr.page_result(mime, cost=0.25)


def test_ocr_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(PNG)
    (tmp_path / "b.jpg").write_bytes(JPG)
    (tmp_path / "c.txt").write_bytes(b"text")
    paths = ["a.png", "b.jpg", "c.txt", "missing.png", "a.png"]
    lines = [json.dumps({"id": i, "path": str(tmp_path / p), "skip_processing": i == 4, "passthrough_data": {"i": i}, "extra": 1}) for i, p in enumerate(paths)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines) + "\n")
    got = sorted(ocr.ocr(str(tmp_path / "in.jsonl"), engine=upper_engine, spark=spark).collect())
    assert [r.status for r in got] == ["ok", "failed", "failed", "failed", "skipped"]
    assert got[0].text == "image/png" and got[0].estimated_cost == 0.25 and got[0].page_count == 1 and got[1].errors == ["no jpeg"] and "missing.png" in got[3].errors[0]
    assert json.loads(got[4].passthrough_data) == {"i": 4} and got[4].text is None
    missing = ocr.ocr(str(tmp_path / "in.jsonl"), "tesseract", pages=PageOptions(rasterize=True), spark=spark)
    if shutil.which("tesseract") is None:
        assert {r.status for r in missing.collect()} == {"failed", "skipped"}
    pdf = ocr.ocr(str(tmp_path / "in.jsonl"), "pdftotext", spark=spark).orderBy("_seq").collect()
    assert [r.status for r in pdf] == ["failed"] * 4 + ["skipped"] and "only PDF" in pdf[0].errors[0]


class PageModel:
    name = "page-model"

    def complete(self, model, prompt, schema, options):
        from inferframe.operators.providers import Completion

        image = prompt["messages"][0]["images"][0]
        return Completion({"full_markdown": image[:21], "analysis": {"image_source": "SCAN", **{f: False for f in pages.FLAGS}}}, 3, 4)


def test_ocr_by_model(spark):
    df = spark.createDataFrame([(1, "a", PNG), (2, "b", b"??")], "id int, path string, content binary")
    priced = spark.createDataFrame([("m", "x", 1.0, 2.0)], models.MODELS)
    got = sorted(ocr.ocr(df, "m", PageModel(), models=priced, with_analysis=True).collect(), key=lambda r: r.id)
    assert (got[0].status, got[0].text, got[0].estimated_cost, tuple(got[0].token_usage), got[0].analysis.image_source) == ("ok", "data:image/png;base64", 11.0, (3, 4), "SCAN")
    assert got[1].status == "failed" and got[1].analysis is None


class CountingModel(PageModel):
    """Writes a file for each call, at the time of the call."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, model, prompt, schema, options):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(str(time.time()))
        return super().complete(model, prompt, schema, options)


@pytest.mark.parametrize("kind", ["llm", "textract", "textract-async"])
def test_ocr_takes_permits(spark, tmp_path, kind):
    """Two calls a second at most: in any second and a little less no more than four begin, since a bucket may be full on both sides."""
    df = spark.createDataFrame([(i, f"s3://b/{i}", PNG) for i in range(10)], "id int, path string, content binary")
    options = LlmOptions(rate_limit="2/s")
    calls = tmp_path / "calls"
    calls.mkdir()
    if kind == "llm":
        out = ocr.ocr(df, "m", CountingModel(str(calls)), options=options, run=RunOptions(jobs=4))
    else:
        out = ocr.ocr(df, kind, options=options, run=RunOptions(jobs=4), service=TimedService(folder=str(calls)))
    assert out.where("status = 'ok'").count() == 10
    times = sorted(float(f.read_text()) for f in calls.iterdir())
    n = {"llm": 10, "textract": 10, "textract-async": 30}[kind]
    assert len(times) == n and times[-1] - times[0] > n / 2 - 2
    assert all(times[i + 4] - times[i] > 0.9 for i in range(n - 4))


def test_example_page():
    kind, data = split_data_url(ocr.EXAMPLE_INPUT)
    assert kind == "image/png" and base64.b64decode(data).startswith(b"\x89PNG") and len(data) < 4000
    prompt = load_prompt(ocr.DEFAULT_PROMPT)
    assert [m.role for m in prompt.messages] == ["user", "assistant", "user"]


def test_engine_options():
    assert [ocr.engine_kind(m) for m in ("pdftotext", "tesseract", "textract", "textract-async", "x")] == ["pdftotext", "tesseract", "textract", "textract-async", "llm"]
    for model, options in (("pdftotext", PageOptions(rasterize=True)), ("tesseract", PageOptions()), ("textract-async", PageOptions(max_pages=1)), ("textract-async", PageOptions(rasterize=True))):
        with pytest.raises(ValueError):
            ocr.check_options(model, options)


class FakeService(ocr.LayoutService):
    def call(self, action, body):
        if action == "StartDocumentAnalysis":
            return {"JobId": "j"}
        if "NextToken" in body:
            return {"JobStatus": "SUCCEEDED", "Blocks": [{"Id": "l2", "BlockType": "LAYOUT_TEXT", "Text": "two"}]}
        return {"JobStatus": "SUCCEEDED", "DocumentMetadata": {"Pages": 2}, "NextToken": "n", "Blocks": [{"Id": "l", "BlockType": "LAYOUT_TEXT", "Relationships": [{"Type": "CHILD", "Ids": ["w"]}]}, {"Id": "w", "BlockType": "LINE", "Text": "one"}]}


class TimedService(FakeService):
    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def call(self, action, body):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(str(time.time()))
        if action == "AnalyzeDocument":
            return {"Blocks": [{"Id": "l", "BlockType": "LAYOUT_TEXT", "Text": "x"}]}
        return super().call(action, body)


def test_layout():
    status, text, errors, count, cost = FakeService().document("s3://b/k", False, sleep=lambda s: None)
    assert (status, text, errors, count, cost) == ("ok", "one\n\ntwo\n", [], 2, 0.008)
    with pytest.raises(FileError):
        FakeService().document("file.pdf", False)
    b = [{"id": "p1", "block_type": "PAGE", "text": None, "children": []}, {"id": "a", "block_type": "LAYOUT_TITLE", "text": "T", "children": ["k"]}, {"id": "k", "block_type": "LINE", "text": "hidden", "children": ["g"]}, {"id": "g", "block_type": "WORD", "text": "shown", "children": []}, {"id": "p2", "block_type": "PAGE", "text": None, "children": []}, {"id": "e", "block_type": "LAYOUT_TEXT", "text": None, "children": ["k"]}]
    assert layout.layout_text(b) == "Tshown \n" and layout.layout_text(b, True) == "Tshown \n\f"
    with pytest.raises(layout.LayoutError):
        layout.layout_text([{"id": "a", "block_type": "LAYOUT_TEXT", "text": None, "children": ["zz"]}])


def random_graph(rng):
    """Blocks with cycles, shared and repeated children, repeated and missing ids."""
    n = rng.randint(0, 9)
    ids = [rng.choice([f"b{i}", f"b{i}", f"b{i}", "b0", None]) for i in range(n)]
    names = [f"b{i}" for i in range(n)] + (["lost"] if rng.random() < 0.1 else [])
    return [{"id": i, "block_type": rng.choice(["PAGE", "LAYOUT_TEXT", "LAYOUT_TITLE", "LINE", "WORD", None]), "text": rng.choice([None, "t", "", f"own {k}"]), "children": rng.choice([None, [], rng.choices(names, k=rng.randint(1, 4))])} for k, i in enumerate(ids)]


@pytest.mark.parametrize("breaks", [False, True])
def test_layout_of_tables(spark, breaks):
    """Random graphs, a long chain, a null: as the visit of one graph after another; no Python in the plan."""
    rng = random.Random(5)
    graphs = [random_graph(rng) for _ in range(400)] + [None, []]
    graphs.append([{"id": f"c{i}", "block_type": "LAYOUT_TEXT" if i == 0 else "LINE", "text": f"{i}" if i % 2 else None, "children": [f"c{i + 1}"] if i < 8 else ["c0"]} for i in range(9)])

    def want(blocks):
        if blocks is None:
            return None, None
        try:
            return layout.layout_text(blocks, breaks), None
        except layout.LayoutError as e:
            return None, str(e)

    df = spark.createDataFrame([(i, g, 1) for i, g in enumerate(graphs)], f"i int, blocks {layout.BLOCKS}, error int").repartition(3)
    out = layout.layout_texts(df, "blocks", breaks)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r.i: (r.text, r.error) for r in out.collect()}
    assert got == {i: want(g) for i, g in enumerate(graphs)}
    assert sum(e is not None for _, e in got.values()) > 5


@pytest.mark.parametrize("breaks", [False, True])
def test_layout_where_the_row_is(spark, breaks):
    """Nothing is shuffled or written, however deep or wide a graph: a chain of 2,000 blocks, a block of 2,000 children, breaks around empty text, a null child."""
    leaf = lambda i: {"id": f"c{i}", "block_type": "LINE", "text": f"{i}", "children": []}
    root = {"id": "r", "block_type": "LAYOUT_TEXT", "text": None}
    page = {"id": None, "block_type": "PAGE", "text": None, "children": None}
    graphs = [
        [root | {"children": ["c0"]}, *(leaf(i) | {"text": str(i) if i % 3 == 0 else None, "children": [f"c{i + 1}"] if i < 1999 else ["r"]} for i in range(2000))],
        [*(leaf(i) for i in range(2000)), root | {"children": [f"c{i * 7 % 2000}" for i in range(2000)]}],
        [page, {"id": "e", "block_type": "LAYOUT_TEXT", "text": "", "children": ["c1"]}, page, leaf(1), root | {"children": ["c1"]}, page, page, root | {"id": "s", "children": ["e", "c1"]}, page],
        [root | {"children": [None, "c1"]}, leaf(1)],
    ]
    df = spark.createDataFrame(list(enumerate(graphs)), f"i int, blocks {layout.BLOCKS}")
    out = layout.layout_texts(df, "blocks", breaks)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and "parquet" not in out._jdf.queryExecution().toString()
    got = {r.i: (r.text, r.error) for r in out.collect()}
    assert [got[i] for i in range(3)] == [(layout.layout_text(g, breaks), None) for g in graphs[:3]]
    assert got[3] == (None, "child block None not found")


def test_benchmark_report(spark):
    raw = spark.createDataFrame([(i, '{"format":"a","documentQuality":"good"}', json.dumps(t)) for i, t in enumerate(["a b", "c", "d"])], "id int, metadata string, true_markdown_output string")
    images = benchmark.read_images(raw)
    assert images.orderBy("id").first().true_markdown == "a b" and images.first().metadata.format == "a" and benchmark.first_images(images, 2).count() == 2
    issues = spark.createDataFrame([(2, "blurry"), (99, "none")], "image_id int, issue string")
    assert [r.image_id for r in benchmark.unknown_issues(images, issues).collect()] == [99]
    outputs = spark.createDataFrame([(0, "m", "a b"), (1, "m", "x"), (2, "m", "zzz"), (0, "n", "a"), (2, "o", "d")], "id int, model string, text string")
    found = benchmark.compare_outputs(benchmark.with_issues(images, issues), outputs)
    got = [(r.model, r.avg_jaccard, r.n_scored) for r in benchmark.model_averages(found, excluded=F.col("ground_truth_issue").isNotNull()).collect()]
    assert got == [("m", 0.5, 2), ("n", 0.5, 1), ("o", None, 0)]
    assert {r.model: r.n_missing for r in benchmark.coverage(images, outputs).collect()} == {"m": 0, "n": 2, "o": 2}


def test_compare_paths(spark, tmp_path):
    (tmp_path / "a").write_text("x y")
    (tmp_path / "b").write_text("x z")
    df = spark.createDataFrame([(1, str(tmp_path / "a"), str(tmp_path / "b")), (2, str(tmp_path / "a"), None), (3, "", str(tmp_path / "b"))], "i int, p string, q string")
    assert [r.jaccard for r in similarity.compare_paths(df, "p", "q").orderBy("i").collect()] == [1 / 3, None, None]
    clash = df.withColumn("diff", F.lit(1)).withColumn("n_added", F.lit(2)).withColumn("jaccard", F.lit("old"))
    got = similarity.compare_paths(clash, "p", "q", out="same").orderBy("i").collect()
    assert [(r.diff, r.n_added, r.jaccard, r.same) for r in got] == [(1, 2, "old", 1 / 3), (1, 2, "old", None), (1, 2, "old", None)]
    missing = spark.createDataFrame([(1, str(tmp_path / "none"), str(tmp_path / "b"))], "i int, p string, q string")
    with pytest.raises(Exception, match="none"):
        similarity.compare_paths(missing, "p", "q").collect()


def test_models(spark):
    info = {"data": [{"model_name": "m", "model_info": {"input_cost_per_token": 1e-6}}, {"model_name": "free"}]}
    assert models.model_rows(info) == [("m", None, 1e-6, 0.0), ("free", None, 0.0, 0.0)]
    assert models.fetch_models(spark, "http://127.0.0.1:1", timeout=1).collect() == []


def test_schemas():
    for name in TYPES:
        made = schema_for(name)
        assert made["title"] == name and made["type"] == "object"
        assert "$ref" not in json.dumps(schema_for(name, inline=True))
    assert schema_for("ChatInput")["required"] == ["id"] and "skipped" in json.dumps(schema_for("OcrOutput"))
    with pytest.raises(ValueError):
        schema_for("Other")


def test_cli(spark, tmp_path, capsys):
    with pytest.raises(SystemExit) as e:
        main(["--help"])
    assert e.value.code == 0
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0
    assert main(["schema", "ChatInput"]) == 0 and '"title": "ChatInput"' in capsys.readouterr().out
    (tmp_path / "in.csv").write_text("id,message\n1,Hello\n2,Bye\n")
    (tmp_path / "p.toml").write_text('[response_schema]\ndescription = "d"\n[response_schema.properties.echo]\ndescription = "e"\n[[messages]]\nuser.text = "{{message}}"\n')
    assert main(["chat", str(tmp_path / "in.csv"), "-p", str(tmp_path / "p.toml"), "-o", str(tmp_path / "out"), "--take-first", "1"]) == 0
    out = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert [(r["id"], r["response"]["echo"]) for r in out] == [("1", "Hello")]
    assert main(["chat", str(tmp_path / "in.csv"), "-p", str(tmp_path / "none.toml"), "-o", str(tmp_path / "o2")]) == 1
    capsys.readouterr()
    assert main(["chat", str(tmp_path / "in.csv"), "-p", str(tmp_path / "p.toml")]) == 0
    assert [json.loads(x)["response"]["echo"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["Hello", "Bye"]
    assert main(["compare", str(tmp_path / "same.csv"), "--column1", "a", "--column2", "b"]) == 0 if (tmp_path / "same.csv").write_text(f"a,b\n{tmp_path / 'in.csv'},{tmp_path / 'in.csv'}\n") else False
    assert capsys.readouterr().out.splitlines()[-1].endswith(",1.0")
    (tmp_path / "texts.jsonl").write_text('{"id":"1","t":"one"}\n')
    assert main(["export-text", str(tmp_path / "texts.jsonl"), "--key", "t", "--new-key", "path", "--path-pattern", str(tmp_path / "{id}.txt")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"id": "1", "path": str(tmp_path / "1.txt")} and (tmp_path / "1.txt").read_text() == "one"
    (tmp_path / "files.csv").write_text(f"id,path\n1,{tmp_path / 'in.csv'}\n")
    assert main(["ocr", str(tmp_path / "files.csv"), "-m", "pdftotext", "-o", str(tmp_path / "o3.csv"), "--allowed-failure-rate", "1"]) == 0
    assert main(["ocr", str(tmp_path / "files.csv"), "-m", "pdftotext", "-o", str(tmp_path / "o4"), "--allowed-failure-rate", "0.5"]) == 1


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":"1","message":"hi"}\n{"id":"2","message":"ho"}\n')
    seen = []
    prompt = {"response_schema": {"description": "d", "properties": {"echo": {"description": "e"}}}, "messages": [{"user": {"text": "{{message}}"}}]}

    def go():
        q = watch_folder(spark, str(tmp_path / "in"), "id string, message string", prompt, str(tmp_path / "out"), str(tmp_path / "cp"), on_counters=lambda n, row: seen.append(row.total))
        q.awaitTermination()

    go()
    (tmp_path / "in" / "b.jsonl").write_text('{"id":"3","message":"x"}\n')
    go()
    got = sorted(json.loads(r.value)["response"]["echo"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["hi", "ho", "x"] and seen == [2, 1]
