"""CSV records with line breaks in their cells, read by many tasks: where a record starts is settled by what each split does to the state before it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is left of a line from the start of a cell on (or of a quoted cell's inside): all its cells, and whether the last is still open.
_REST = r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+'
_OPEN = re.compile(_REST + r'"(?:[^"]|"")*+\Z', re.S)
_CLOSE = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:\Z|,)', re.S)

_STATES = "file string, start long, open_if_out boolean, open_if_in boolean, records_if_out long, records_if_in long"


def still_open(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind this line, if one was (inside) or wasn't before it. Quotes inside an unquoted cell are its text."""
    if '"' not in line:
        return inside
    if not inside:
        return bool(_OPEN.match(line))
    close = _CLOSE.match(line)
    if not close:
        return True
    return close[0].endswith(",") and bool(_OPEN.match(line, close.end()))


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of the file and its splits; a line is the split's that it starts in."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(values of the other columns, lines) for runs of lines of one split; a split may come in several runs."""
    for batch in batches:
        *key, text = (c.to_pylist() for c in batch.columns)
        at = 0
        for i in range(1, len(text) + 1):
            if i == len(text) or any(k[i] != k[at] for k in key[:2]):
                yield tuple(k[at] for k in key), text[at:i]
                at = i


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does: whether a cell is open behind it and how many records start in it, for both states before it."""
    done: dict[tuple, list] = {}
    for key, lines in _runs(batches):
        state = done.setdefault(key, [False, True, 0, 0])
        for line in lines:
            for k in range(2):
                state[2 + k] += not state[k] and not _blank(line)
            if '"' in line:
                state[0], state[1] = still_open(line, state[0]), still_open(line, state[1])
    rows = [(*key, *state) for key, state in done.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in _STATES.split(", ")])


def split_states(spark: SparkSession, path: str | list[str]) -> tuple[list[tuple], int]:
    """((file, start, whether a cell is open before it, records before it, its file's place, that file's header's number, its own place) of each split, records in all but headers).

    One pass over the lines; a few numbers for each split reach the driver, which composes them. Each
    file's first record is its header. Raises ValueError where a file ends inside a cell.
    """
    rows = sorted(_lines(spark, path).mapInArrow(_effects, _STATES).collect(), key=lambda r: (r.file, r.start))
    out, inside, total, files, header = [], False, 0, 0, 0
    for i, r in enumerate(rows):
        if not i or r.file != rows[i - 1].file:
            if inside:
                raise ValueError(f"{rows[i - 1].file} ends inside a quoted cell")
            files, header = files + 1, total
        out.append((r.file, r.start, inside, total, files - 1, header, i))
        total += r.records_if_in if inside else r.records_if_out
        inside = r.open_if_in if inside else r.open_if_out
    if inside:
        raise ValueError(f"{rows[-1].file} ends inside a quoted cell")
    headers = sum(a[5] != b[5] for a, b in zip(out, out[1:], strict=False)) + (total > out[-1][5]) if out else 0
    return out, total - headers


_KEY = "file string, start long, inside boolean, base long, number long, header long, place long"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_seq, whole, place, record): records, and the pieces of those that lie in more than one split; no headers."""
    names, types = ("_seq", "whole", "place", "record"), (pa.int64(), pa.bool_(), pa.int64(), pa.string())
    key, held, record, inside, whole, out = None, [], 0, False, True, []

    def add(complete: bool) -> None:
        *_, number, header, place = key
        if record != header:
            out.append((record - number - 1, complete, place, "\n".join(held)))
        held.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

    for now, lines in _runs(batches):
        if now != key:
            if held:
                add(False)
            key, inside, record = now, now[2], now[3] - 1  # an open cell is that of the last record before
            whole = not inside
        for line in lines:
            if not inside:
                if _blank(line):
                    continue
                record, whole = record + 1, True
            held.append(line)
            inside = still_open(line, inside)
            if not inside:
                add(whole)
        if len(out) > 1000:
            yield batch()
            out = []
    if held:
        add(False)
    yield batch()


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_seq, record): the text of each record behind the headers, with its number from 0 in the order of files and lines.

    Records end with \\n or \\r\\n, and their quoted cells may hold both; empty lines are none. Files are split like any text. A first pass
    settles the state before each split (split_states); where no split starts inside a cell, a second makes all
    records, and else one more puts the pieces of those together that lie in more than one split.
    """
    states, _ = split_states(spark, path)
    known = F.broadcast(spark.createDataFrame(states, _KEY))
    lines = _lines(spark, path).join(known, ["file", "start"]).select("file", "start", "inside", "base", "number", "header", "place", "value")
    made = lines.mapInArrow(_records, "_seq long, whole boolean, place long, record string")
    out = made.where("whole").select("_seq", "record")
    if any(s[2] for s in states):
        parts = made.where("not whole").groupBy("_seq").agg(F.array_sort(F.collect_list(F.struct("place", "record"))).alias("p"))
        out = out.unionByName(parts.select("_seq", F.array_join("p.record", "\n").alias("record")))
    return out.withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def count_csv(spark: SparkSession, path: str | list[str]) -> int:
    """Number of records behind the headers; none is parsed."""
    return split_states(spark, path)[1]
