import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.sources import quoted, readers


def write(path, rows, r, end="\n"):
    cell = lambda c: '"' + c.replace('"', '""') + '"' if r.random() < 0.3 or any(x in c for x in ',"\n') or c == "" and r.random() < 0.5 else c
    out = []
    for row in rows:
        out.append(",".join(map(cell, row)))
        if r.random() < 0.02:
            out.append("")  # a blank line between records
    path.write_bytes((end.join(out) + (end if r.random() < 0.5 else "")).encode())


def made_up(seed, n):
    r = random.Random(seed)
    parts = ["a", "b,c", "line\nfeed", 'say "x"', "\n\n", '"', '""', ",", " ", "é日本", "12.5", "", 'end"\n', "x" * 200, '5" pipe']
    return r, [["Id", "Text", "Other cell"]] + [[str(i), "".join(r.choice(parts) for _ in range(r.randrange(6))), r.choice(parts)] for i in range(n)]


def one_task(spark, path):
    df = spark.read.options(header=True, multiLine=True, **quoted.OPTIONS).csv(path)
    return [tuple(x) for x in df.toDF(*[c.removeprefix("﻿") for c in df.columns]).collect()]


@pytest.mark.parametrize("seed,block", [(1, 1000), (2, 173), (3, 1 << 20)])
def test_rows_of_the_one_task_reader_from_many_tasks(spark, tmp_path, seed, block):
    r, rows = made_up(seed, 600)
    write(tmp_path / "rows.csv", rows, r)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    got = quoted.read_quoted(own, str(tmp_path / "rows.csv"))
    tasks = own.read.text(str(tmp_path / "rows.csv")).rdd.getNumPartitions()
    found = got.collect()
    print(f"blocks of {block} bytes: {tasks} tasks, {sum(chr(10) in (x.Text or '') for x in found)} cells with line feeds")
    assert tasks > 10 or block > 1000
    assert [x.row_number for x in found] == list(range(1, 601))
    assert [tuple(x)[:-1] for x in found] == one_task(spark, str(tmp_path / "rows.csv"))
    assert found[5].Id == "5" and [(x.Text or "") for x in found] == [row[1] for row in rows[1:]]


def test_a_record_over_many_blocks_files_in_order_and_marks(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    long = "\n".join(f"line {i}, with a comma" for i in range(300))
    (folder / "a.csv").write_text('﻿Id,Text\n1,"' + long + '"\n2,x\n\n3,"never closed\n\n4,y\n')
    (folder / "b.csv").write_text('Id,Text\n5\n6,"a",surplus\n7, spaced \n')
    (folder / "c.csv").write_text("Id,Text\n")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "300")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    got = quoted.read_quoted(own, str(folder))
    assert got.columns == ["Id", "Text", "row_number"]
    rows = got.orderBy("row_number").collect()
    assert [(x.Id, x.row_number) for x in rows] == [("1", 1), ("2", 2), ("3", 3), ("5", 4), ("6", 5), ("7", 6)]
    assert rows[0].Text == long and rows[2].Text.startswith("never closed\n\n4,y") and rows[3].Text is None and rows[5].Text == " spaced "
    assert readers.read_table(own, str(folder)).count() == 6


def test_states_equal_step_by_step():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        codes = r.integers(0, 8, n).astype(np.int8)
        for start in (0, 1):
            now, want = start, [start]
            for c in codes:
                now = int(bool(c & (quoted.OPEN_FROM_QUOTES if now else quoted.OPEN_FROM_RECORD)))
                want.append(now)
            assert quoted.states(codes, start).tolist() == want


def test_line_codes(spark):
    lines = {"a,b": 2, '"a,b': 1 | 2, '"': 1, 'x"': 0, '"a","b"': 2 * 0, 'a"b,c': 0, '""': 2, '"a""': 1 | 2, 'c","d': 1 | 0, "": 2}
    df = spark.createDataFrame([(k,) for k in lines], "line string").select("line", quoted.line_code(F.col("line")).alias("code")).collect()

    def by_hand(line, inside):
        i, at_start = 0, True
        while i < len(line):
            if inside:
                if line[i] == '"':
                    if line[i : i + 2] == '""':
                        i += 1
                    else:
                        inside = False
                        while i + 1 < len(line) and line[i + 1] != ",":
                            i += 1
                i += 1
                at_start = False
                continue
            if line[i] == '"' and at_start:
                inside = True
            at_start = line[i] == ","
            i += 1
        return inside

    for r in df:
        assert bool(r.code & 1) == by_hand(r.line, False), r
        assert bool(r.code & 2) == by_hand(r.line, True), r
        assert bool(r.code & 4) == (r.line != "")
