import json
import os
import random
import time
import uuid

from pyspark.sql import functions as F

from inferframe.operators import providers, retry
from inferframe.operators.chat import RESULT
from inferframe.operators.pages import merge_pages
from inferframe.streaming.page_merge import merge_page_stream
from inferframe.streaming.retries import call_stream

SCHEMA = "doc_id long, page_idx int, total_pages long, text string, errors array<string>, estimated_cost double, token_usage struct<prompt_tokens:bigint,completion_tokens:bigint>"


def some_pages(n=30):
    rng = random.Random(4)
    out = []
    for doc in range(n):
        total = rng.randint(1, 5)
        for i in range(total):
            bad = rng.random() < 0.2
            out.append({"doc_id": doc, "page_idx": i, "total_pages": total, "text": None if bad else f"text {doc} {i}", "errors": [f"bad {i}"] if bad else [], "estimated_cost": 0.5, "token_usage": {"prompt_tokens": i, "completion_tokens": 1}})
    rng.shuffle(out)
    return out


def rows(df):
    return sorted((r.doc_id, r.status, r.text, "|".join(r.errors), r.page_count, r.estimated_cost) for r in df.collect())


def test_pages_over_many_batches(spark, tmp_path):
    """Pages in any order, over batches and a restart, give what one table of them gives; those that wait are not emitted."""
    pages = some_pages()
    want = rows(merge_pages(spark.createDataFrame(pages, SCHEMA), ["doc_id"]))
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = []

    def write(df, number):
        batches.append(number)
        df.write.mode("append").parquet(out)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(str(source))
        merge_page_stream(stream, ["doc_id"], write, str(tmp_path / "checkpoint")).awaitTermination()

    parts = [pages[i::7] for i in range(7)]
    for i, part in enumerate(parts[:4]):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    go()
    early = rows(spark.read.parquet(out))
    seen = {doc: sum(p["doc_id"] == doc for part in parts[:4] for p in part) for doc in range(30)}
    totals = {p["doc_id"]: p["total_pages"] for p in pages}
    assert {r[0] for r in early} == {d for d in seen if seen[d] == totals[d]} and len(early) < len(want)
    repeated = parts[3][:3]  # pages that come again while their document waits count once
    again = [p for p in repeated if seen[p["doc_id"]] < totals[p["doc_id"]]]
    for i, part in enumerate([parts[4] + again, *parts[5:]]):
        (source / f"{i + 4}.json").write_text("\n".join(map(json.dumps, part)))
    go()
    assert rows(spark.read.parquet(out)) == want and len(batches) >= 4


def test_rows_without_pages_pass_at_once(spark, tmp_path):
    source, got = tmp_path / "in", []
    source.mkdir()
    (source / "a.json").write_text('{"doc_id":1,"errors":[],"error":"gone"}\n{"doc_id":2,"page_idx":0,"total_pages":2,"text":"x","errors":[]}\n')
    stream = spark.readStream.schema(SCHEMA + ", error string").json(str(source))
    merge_page_stream(stream, ["doc_id"], lambda df, n: got.extend(df.select("doc_id", F.array_join("errors", "|").alias("e")).collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r.doc_id, r.e) for r in got] == [(1, "gone")]


class Failing:
    """Fails as often as the row says, in all runs together, and leaves a file for each call."""

    name = "failing"

    def __init__(self, folder):
        self.folder = folder

    def complete(self, model, prompt, schema_, options):
        text = providers.last_user(prompt)
        name, failures = text.split(" ")
        before = len([f for f in os.listdir(self.folder) if f.startswith(f"{name}-")])
        with open(os.path.join(self.folder, f"{name}-{uuid.uuid4().hex}"), "w"):
            pass
        if failures == "fatal":
            raise retry.Fatal("never")
        if before < int(failures):
            raise retry.Transient(f"busy {before}")
        return providers.Completion({"a": name}, 1, 2)


def test_failed_rows_wait_in_state(spark, tmp_path):
    """Each row is called as often as it fails and once more, over batches and a restart; nothing that was answered is called again."""
    calls, source, out = tmp_path / "calls", tmp_path / "in", str(tmp_path / "out")
    calls.mkdir()
    source.mkdir()
    cases = {"a": "0", "b": "1", "c": "3", "d": "fatal", "e": "99", "f": "2"}
    (source / "1.json").write_text("\n".join(json.dumps({"id": k, "n": v, "skip_processing": False}) for k, v in cases.items()) + '\n{"id":"s","n":"0","skip_processing":true}\n')
    prompt = {"response_schema": {"description": "x", "properties": {"a": {"description": "a"}}}, "messages": [{"user": {"text": "{{name}} {{n}}"}}]}

    def start():
        rows = spark.readStream.schema("id string, n string, skip_processing boolean").json(str(source)).withColumn("name", F.col("id"))
        found = call_stream(rows, prompt, Failing(str(calls)), "m", longest_ms=50)
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()

    def answered():
        return {} if not os.path.exists(out) else {json.loads(r.id): r for r in spark.read.schema(f"id string, passthrough_data string, {RESULT}").parquet(out).collect()}

    def until(query, n):
        end = time.time() + 120
        while len(answered()) < n and time.time() < end:
            assert query.exception() is None
            time.sleep(0.2)
        query.stop()

    until(start(), 3)
    first = {k: len([f for f in os.listdir(calls) if f.startswith(f"{k}-")]) for k in answered()}
    (source / "2.json").write_text('{"id":"g","n":"1","skip_processing":false}\n')
    until(start(), 8)
    got = answered()
    assert {k: (r.status, len(r.errors)) for k, r in got.items()} == {"a": ("ok", 0), "b": ("ok", 1), "c": ("ok", 3), "d": ("failed", 1), "e": ("failed", 6), "f": ("ok", 2), "g": ("ok", 1), "s": ("skipped", 0)}
    made = {k: len([f for f in os.listdir(calls) if f.startswith(f"{k}-")]) for k in got}
    assert all(made[k] == n for k, n in first.items()) and made["a"] == made["d"] == 1 and made["s"] == 0
    assert got["b"].errors == ["busy 0"] and got["c"].response == '{"a":"c"}' and got["c"].token_usage.completion_tokens == 2
