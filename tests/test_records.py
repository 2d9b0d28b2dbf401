import io
import json

import pytest
from pyspark.sql import functions as F

from inferframe.sources import records as rec


def lines(folder):
    out = []
    for p in sorted(folder.glob("part-*")):
        out += p.read_text().splitlines()
    return out


def test_jsonl_keeps_types_and_order(spark, tmp_path):
    rows = [{"id": i if i % 2 else f"s{i}", "x": {"a": [1, None]}, "n": 1.5, "passthrough_data": {"count": 42}} for i in range(200)]
    path = tmp_path / "in.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    df = rec.read_records(spark, str(path))
    got = sorted(df.select("_seq", "id", "passthrough_data", "skip_processing").collect())
    assert [r._seq for r in got] == list(range(200))
    assert [json.loads(r.id) for r in got] == [r["id"] for r in rows] and json.loads(got[0].passthrough_data) == {"count": 42} and got[0].skip_processing is None
    assert sorted(r._seq for r in rec.take(df, 5, 3).collect()) == [5, 6, 7]
    assert rec.count_records(spark, str(path)) == 200


@pytest.mark.parametrize("bad", ["{", "", "[1]", '{"x": 1}', '{"id": 1, "skip_processing": "yes"}'])
def test_bad_lines_fail_the_run(spark, tmp_path, bad):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": 1}\n' + bad + "\n" + '{"id": 2}\n')
    with pytest.raises(Exception):
        rec.read_records(spark, str(path)).select("id", "skip_processing").collect()


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,joke,skip_processing,passthrough_data\n1,"a ""q""\nb",true,x\n2,,,\n')
    got = sorted(rec.read_records(spark, str(path)).collect())
    assert [(r.id, r.joke, r.skip_processing, r.passthrough_data) for r in got] == [('"1"', 'a "q"\nb', True, '"x"'), ('"2"', "", None, None)]
    assert rec.count_records(spark, str(path)) == 2
    (tmp_path / "noid.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        rec.read_records(spark, str(tmp_path / "noid.csv"))


def test_sniffing(spark):
    assert rec.spool(spark, io.BytesIO(b'{"id":1}\n')).endswith(".jsonl") and rec.spool(spark, io.BytesIO(b" \nid\n1\n")).endswith(".csv")
    with pytest.raises(ValueError):
        rec.spool(spark, io.BytesIO(b""))


def test_jsonl_sink_has_both_kinds_of_null(spark, tmp_path):
    df = spark.createDataFrame([(1, '"b"', None, None, "ü\n"), (0, "7", 0.5, "t", None)], "_seq int, id string, cost double, text string, note string")
    rec.write_jsonl(df, str(tmp_path / "out"), optional=("cost",), raw=("id",), single=True, order="_seq")
    assert lines(tmp_path / "out") == ['{"id":7,"cost":0.5,"text":"t","note":null}', '{"id":"b","text":null,"note":"ü\\n"}']


def test_csv_sink_and_flat_rows(spark, tmp_path):
    df = spark.createDataFrame([('"a\\"b"', "ok", [], "p", "t"), ("12", "failed", ["x", "y"], "q", None)], "id string, status string, errors array<string>, path string, text string")
    rec.write_csv(rec.flat_rows(df), str(tmp_path / "out"), single=True)
    got = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("12", "failed", "x\n\ny", "q", None), ('a"b', "ok", None, "p", "t")]


def test_export_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "one"), (2, None)], "id int, text string")
    out = rec.export_text(df, "id", "text", "path", str(tmp_path / "x" / "{id}.txt"))
    for _ in range(2):
        got = {r.id: r.path for r in out.collect()}
    assert got == {1: str(tmp_path / "x" / "1.txt"), 2: None} and (tmp_path / "x" / "1.txt").read_text() == "one"
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["1.txt"]


def test_numbering_over_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(5)))
    got = sorted(tuple(r) for r in rec.number_rows(spark.read.text(str(tmp_path))).select("_seq", F.col("value")).collect())
    assert got == [(k * 5 + i, f"{k}-{i}") for k in range(3) for i in range(5)]
