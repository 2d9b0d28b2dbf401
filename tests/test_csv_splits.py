import csv
import io
import random

import pytest

from inferframe.sources.csv_splits import count_csv, csv_records, split_states, still_open
from inferframe.sources.records import count_records, read_csv


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that records and cells lie over many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "101b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_state_of_lines():
    """Against a parser of characters, for both states before."""

    def plain(line, inside):
        at, start = 0, not inside
        while True:
            if inside:
                while at < len(line):
                    if line[at] == '"':
                        if line[at + 1 : at + 2] != '"':
                            break
                        at += 1
                    at += 1
                if at >= len(line):
                    return True
                inside, at = False, at + 1
            elif start and line[at : at + 1] == '"':
                inside, at = True, at + 1
                continue
            comma = line.find(",", at)
            if comma < 0:
                return False
            at, start = comma + 1, True

    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('"",a\r') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            assert still_open(line, inside) == plain(line, inside), (line, inside)


def some_rows(rng, n):
    cells = ["", "a", "b c", 'say "hi"', "x,y", "two\nlines", "\n\n", 'q"\n"', "é\r\nü", "long " * 20, '5" wide']
    return [[str(i), *(rng.choice(cells) for _ in range(3))] for i in range(n)]


def written(rows, path, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "t", "u", "v w"], *rows])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits(spark, tmp_path, tiny_splits, end):
    """Files whose records and cells lie over splits give the rows and numbers that were written, and those of the one-task scan."""
    rng = random.Random(len(end))
    folder = tmp_path / "in.csv"
    folder.mkdir()
    parts = [some_rows(rng, n) for n in (60, 0, 1, 25)]
    for i, rows in enumerate(parts):
        written(rows, folder / f"{i}.csv", end)
    (folder / "9.csv").write_bytes(b"")
    want = [r for rows in parts for r in rows]
    got = read_csv(spark, str(folder))
    assert csv_records(spark, str(folder)).rdd.getNumPartitions() > 20
    rows = sorted((r._seq, r.id, r.t, r.u, r["v w"]) for r in got.collect())
    assert rows == [(i, f'"{r[0]}"', *r[1:]) for i, r in enumerate(want)]
    assert any(s[2] for s in split_states(spark, str(folder))[0])
    assert count_records(spark, str(folder)) == count_csv(spark, str(folder)) == len(want)
    scan = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="", nullValue="\0").csv([str(folder / f"{i}.csv") for i in range(4)])
    # in files with \r\n the one-task scan changes those inside cells to \n, too
    assert sorted(tuple((c or "").replace("\r\n", "\n") for c in r) for r in scan.collect()) == sorted(tuple(c.replace("\r\n", "\n") for c in r) for r in want)


def test_odd_files(spark, tmp_path, tiny_splits):
    """Blank lines, no last line end, quotes inside unquoted cells, a header with line breaks, a cell longer than many splits."""
    path = tmp_path / "odd.csv"
    path.write_text('id,"two\nlines"\n\n1,5" pipe\n2,a"b"c\n\n3,"' + "x\n" * 200 + '"\n4,last')
    rows = sorted((r._seq, r.id, r["two\nlines"]) for r in read_csv(spark, str(path)).collect())
    assert rows == [(0, '"1"', '5" pipe'), (1, '"2"', 'a"b"c'), (2, '"3"', "x\n" * 200), (3, '"4"', "last")]
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("id,t\n1,a\n2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(ragged)).collect()
    opened = tmp_path / "open.csv"
    opened.write_text('id,t\n1,"a\n')
    with pytest.raises(ValueError, match="ends inside"):
        read_csv(spark, str(opened))
    head = tmp_path / "head.csv"
    head.write_text("id,t\n")
    assert read_csv(spark, str(head)).count() == 0 == count_records(spark, str(head))
