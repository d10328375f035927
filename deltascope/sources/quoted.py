"""CSV with line feeds inside quotes, read by many tasks.

A quoted cell may go on over lines, so whether a line begins a record depends on all lines
before it in its file. But a line can begin in two states only, between records or inside
quotes, and what it does to either is told by the line alone. So each block of a file (the
split that Spark's text source gives a task) works out both at once: the state that it
would end in, and the records that would begin in it. These few bytes a block are put one
behind the other, which gives every block its true start; then all blocks cut their lines into
records in parallel. Only records that lie over the edge of a block are put together by a
shuffle. Row numbers follow from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
OPEN_FROM_RECORD, OPEN_FROM_QUOTES, FILLED = 1, 2, 4


def _left_open(text: Column) -> Column:
    """Whether text that follows an opening quote does not close it: doubled quotes aside."""
    return ~F.contains(F.replace(text, F.lit('""'), F.lit("")), F.lit('"'))


def line_code(line: Column) -> Column:
    """What a line does: the states it ends in after beginning at a record or inside quotes,
    and whether it holds anything. A quote opens a cell only where the cell begins; what
    follows a closing quote belongs to the cell up to the next comma."""

    def over(states: Column, piece: Column) -> Column:
        opens = F.startswith(piece, F.lit('"')) & _left_open(F.substring(piece, F.lit(2), F.length(piece)))
        stays = _left_open(piece)
        step = lambda s: F.when(s, stays).otherwise(opens)
        return F.struct(step(states["r"]).alias("r"), step(states["q"]).alias("q"))

    both = F.aggregate(F.split(line, ",", -1), F.struct(F.lit(False).alias("r"), F.lit(True).alias("q")), over, lambda s: s["r"].cast("int") * OPEN_FROM_RECORD + s["q"].cast("int") * OPEN_FROM_QUOTES)
    return F.when(F.contains(line, F.lit('"')), both).otherwise(OPEN_FROM_QUOTES) + F.when(line != "", FILLED).otherwise(0)


def states(codes: np.ndarray, start: int) -> np.ndarray:
    """The state (1: inside quotes) before each line and after the last, from a start state.
    A line keeps the state, turns it, or sets it: what counts is the last that sets it, and
    how often it was turned since."""
    a, b = codes & OPEN_FROM_RECORD > 0, codes & OPEN_FROM_QUOTES > 0
    turns = np.concatenate([[0], np.cumsum(a & ~b)])
    sets = np.concatenate([[-1], np.maximum.accumulate(np.where(a == b, np.arange(len(codes)), -1))])
    value = np.where(sets >= 0, a[sets] if len(a) else False, bool(start))
    since = turns - np.where(sets >= 0, turns[sets + 1], 0)
    return (value ^ (since % 2 == 1)).astype(np.int8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches, each of one block, with the block's key (file, start)."""
    for batch in batches:
        file, start = (batch[c].to_numpy() for c in ("file", "start"))
        edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for i, j in zip([0, *edges], [*edges, len(file)]):
            if j > i:
                yield (int(file[i]), int(start[i])), batch.slice(i, j - i)


def _summaries(batches):
    """One row a block: for each start state its end state and the records that begin in it."""
    found: dict[tuple, list] = {}
    for key, part in _blocks(batches):
        codes = part["code"].to_numpy()
        held = found.setdefault(key, [0, 1, 0, 0])
        for s in (0, 1):
            before = states(codes, held[s])
            held[2 + s] += int(((before[:-1] == 0) & (codes & FILLED > 0)).sum())
            held[s] = int(before[-1])
    rows = [(*k, *v) for k, v in found.items()]
    names = ("file", "start", "end0", "end1", "records0", "records1")
    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


class _Cutter:
    """Cuts the lines of one block into records. `state` is its true start, `begun` the records
    of its file that began before it, `left_open` the one that its first lines go on with."""

    def __init__(self, key: tuple, state: int, base: int, begun: int, left_open: int) -> None:
        self.key, self.state, self.base, self.next = key, state, base, begun
        self.record, self.whole, self.lines = left_open, False, []

    def take(self, part: pa.RecordBatch) -> list[tuple]:
        codes, text, out = part["code"].to_numpy(), part["value"].to_pylist(), []
        before = states(codes, self.state)
        between = before[:-1] == 0
        starts, blank = np.flatnonzero(between & (codes & FILLED > 0)), between & (codes & FILLED == 0)
        if blank.any():
            text = [None if b else t for t, b in zip(text, blank.tolist())]
        edges = starts.tolist()
        self.lines += text[: edges[0] if edges else len(text)]
        for i, j in zip(edges, [*edges[1:], len(text)]):
            out += self.done(self.whole)
            self.record, self.whole, self.lines = self.next, True, text[i:j]
            self.next += 1
        self.state = int(before[-1])
        return out

    def done(self, whole: bool) -> list[tuple]:
        """The record so far, unless it is the header or nothing but blank lines."""
        lines = [x for x in self.lines if x is not None]
        return [(self.base + self.record, self.key[1], whole, "\n".join(lines))] if lines and self.record > 0 else []

    def end(self) -> list[tuple]:
        return self.done(self.whole and not self.state)


def _places(summary: list, order: dict[int, int]) -> tuple[dict, bool]:
    """For each block (file, start) its true start state, the rows of the files before its
    file, the records of its file before it and the one left open; and whether any
    record lies over an edge."""
    found, spans, rows, file, state, begun, left_open = {}, False, 0, None, 0, 0, 0
    for r in sorted(summary, key=lambda r: (order[r.file], r.start)):
        if r.file != file:
            rows += max(0, begun - 1)  # all but the header
            spans |= bool(state)
            file, state, begun, left_open = r.file, 0, 0, 0
        found[r.file, r.start] = (state, rows, begun, left_open)
        spans |= bool(state)
        records, state = ((r.records0, r.end0), (r.records1, r.end1))[state]
        begun += records
        if records:
            left_open = begun - 1
    return found, spans or bool(state)


def read_quoted(spark: SparkSession, path: str, number: str = "row_number") -> DataFrame:
    """The records of CSV files with headers, all cells as text, numbered from 1 in the order
    of files (by path) and records; rows also lie in that order. Equal to Spark's own
    multi-line reader, which takes one task a file. Lines end with a line feed, with or
    without a carriage return before it; alone that is part of a cell. A quote that is never closed goes on to
    the end of its file. The driver and every task hold some 100 bytes a block (128 MB of text)."""
    source = spark.read.option("lineSep", "\n").text(path)
    file = lambda p: F.xxhash64(F.regexp_replace(p, "^([^/]*):/+", "$1:/"))  # noqa: E731  file:/ and file:/// alike
    line = F.regexp_replace("value", "\r$", "")
    lines = source.select(file(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"), line.alias("value"), line_code(line).cast("byte").alias("code"))
    schema = spark.read.options(header=True, multiLine=True, **OPTIONS).csv(path).schema
    files = spark.createDataFrame([(f,) for f in source.inputFiles()], "p string").select("p", file(F.col("p")).alias("file")).collect()
    order = {r.file: i for i, r in enumerate(sorted(files, key=lambda r: r.p))}
    summary = lines.select("file", "start", "code").mapInArrow(_summaries, "file long, start long, end0 long, end1 long, records0 long, records1 long").collect()
    places, spans = _places(summary, order)
    known = spark.sparkContext.broadcast(places)

    def cut(batches):
        block = None
        for key, part in _blocks(batches):
            out = []
            if block is None or key != block.key:
                out = block.end() if block else []
                block = _Cutter(key, *known.value[key])
            out += block.take(part)
            if out:
                yield _rows(out)
        if block and (out := block.end()):
            yield _rows(out)

    records = lines.mapInArrow(cut, "n long, start long, whole boolean, record string")
    if spans:
        pieces = F.array_sort(F.collect_list(F.struct("start", "record")))
        parts = records.where("not whole").groupBy("n").agg(F.concat_ws("\n", F.transform(pieces, lambda x: x["record"])).alias("record"))
        records = records.where("whole").select("n", "record").unionByName(parts).repartitionByRange("n").sortWithinPartitions("n")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)
    out = records.select(F.from_csv("record", ddl, OPTIONS).alias("cells"), F.col("n").alias("_n")).select("cells.*", F.col("_n").alias(number))
    return out.toDF(*[c.removeprefix("\ufeff") for c in out.columns])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    n, start, whole, record = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(whole, pa.bool_()), pa.array(record, pa.string())], names=["n", "start", "whole", "record"])
