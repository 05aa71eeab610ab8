"""Rows and cells of CSV text, against reading characters one after another."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from headway.sources import csvrows, files
from tests.feeds import codes

PAD = "".join(map(chr, range(33)))


def plain_rows(lines):
    """(number of the last line, text) of each row: a quote opens a cell only at its start."""
    out, held, state = [], [], "start"
    for n, line in enumerate(lines, 1):
        held.append(line)
        for c in line:
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
            elif state == "bare":
                state = "start" if c == "," else "bare"
            elif state == "quoted":
                state = "closing" if c == '"' else "quoted"
            else:
                state = "quoted" if c == '"' else "start" if c == "," else "bare"
        if state != "quoted":
            out.append((n, "\n".join(held)))
            held, state = [], "start"
    return out + ([(len(lines), "\n".join(held))] if held else [])


def plain_cells(row):
    """Cells of a row: as a scanner that passes over blanks before quotes reads them, if the plain reader finds as many."""
    at, found = 0, []
    while True:
        begin = at
        while at < len(row) and row[at] <= " " and row[at] not in "\r\n":
            at += 1
        if row[at : at + 1] == '"':
            content, at = "", at + 1
            while at < len(row) and (row[at] != '"' or row[at + 1 : at + 2] == '"'):
                content += row[at]
                at += 2 if row[at] == '"' else 1
            closed = at < len(row)
            end = row.find(",", at + 1) if closed else -1
            end = len(row) if end < 0 else end
            rest = row[at + 1 : end]
            found.append(content + "\n" if not closed else content if not rest.strip(PAD) else ('"' + content + '"' + rest).rstrip(PAD))
            at = end if closed else len(row)
        else:
            end = row.find(",", begin)
            end = len(row) if end < 0 else end
            found.append(row[begin:end].strip(PAD))
            at = end
        if at >= len(row):
            break
        at += 1
    read = next(csv.reader([row], strict=False)) if "\n" not in row else next(csv.reader(row.splitlines(keepends=True)))
    return found if len(read or [""]) == len(found) else [c.strip(PAD) for c in read]


#: Rows with the cells that they have.
KNOWN = [
    ("a,b,c", ["a", "b", "c"]), ('a, b ,"b"  ', ["a", "b", "b"]), ('"  x  ",y', ["  x  ", "y"]), ('" "', [" "]), ("   ,x", ["", "x"]), ('A,5" Pipe,1', ["A", '5" Pipe', "1"]),
    ('"stop_i"d,x', ['"stop_i"d', "x"]), ('a,"b"c"d,e', ["a", '"b"c"d', "e"]), ('"a ""b""",c', ['a "b"', "c"]), ('"a""b"c""d,e', ['"a"b"c""d', "e"]), ('a, "b" ,c', ["a", "b", "c"]),
    ('a, " x ",c', ["a", " x ", "c"]), ('a, "b,c",d', ["a", '"b', 'c"', "d"]), ('"b" ,c', ['"b" ', "c"]), ('"b" c ,d', ['"b" c', "d"]), ('a,"b', ["a", "b\n"]), ('"Open', ["Open\n"]), ('"a,b', ["a,b\n"]),
    (",,", ["", "", ""]), ('""', [""]), ('"",x', ["", "x"]), ('"""",x', ['"', "x"]), ('"two\nlines", b', ["two\nlines", "b"]), ("é,日本 ,😀", ["é", "日本", "😀"]), ("\tx\t,y", ["x", "y"]), (" x,y", [" x", "y"]),
]


def test_known_rows(spark):
    assert [plain_cells(row) for row, _ in KNOWN] == [want for _, want in KNOWN]
    df = spark.createDataFrame([(i, row) for i, (row, _) in enumerate(KNOWN)], "i long, value string")
    found = {r["i"]: r["c"] for r in df.select("i", csvrows.cells_of(F.col("value")).alias("c")).collect()}
    assert [found[i] for i in range(len(KNOWN))] == [want for _, want in KNOWN]


def test_cells_of_random_rows(spark):
    r = random.Random(4)
    rows = ["".join(r.choices('ab",  \t😀', k=r.randrange(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, value string")
    found = {x["i"]: x["c"] for x in df.select("i", csvrows.cells_of(F.col("value")).alias("c")).collect()}
    bad = [(row, found[i], plain_cells(row)) for i, row in enumerate(rows) if found[i] != plain_cells(row)]
    assert not bad, bad[:5]


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_quoted_line_breaks_over_blocks(spark, block):
    r = random.Random(block)
    kinds = ["a,b", 'x,"y', 'z",w', '"q""r"', '"', "", '"""', 'A,5" Pipe', '",', '"" ,"', 'p"q"', '""x,"y""']
    files_of = {f: [r.choice(kinds) for _ in range(60)] for f in "fg"} | {"h": ["a,b", "c"], "i": ['x,"open', "to", "the end"]}
    lines = [(f, "stops.txt", n, v) for f, own in files_of.items() for n, v in enumerate(own, 1)]
    df = spark.createDataFrame(lines, files.LINES).repartition(3)
    found = sorted((x["feed_id"], x["line_number"], x["value"]) for x in csvrows.join_quoted(df, block).collect())
    assert found == sorted((f, n, v) for f, own in files_of.items() for n, v in plain_rows(own))


def test_long_rows_need_no_stack(spark):
    row = ",".join(['"a""b"'] * 100_000)
    df = spark.createDataFrame([(row,), (row + ',"open',), ('"' + '""' * 200_000 + '",x',)], "value string")
    cells = csvrows.cells_of(F.col("value"))
    found = df.select(F.col("value").rlike(csvrows.OPENS).alias("opens"), F.size(cells).alias("n"), F.length(F.get(cells, F.lit(0))).alias("first")).collect()
    assert [tuple(r) for r in found] == [(False, 100_000, 3), (True, 100_001, 3), (False, 2, 200_000)]


def lines_df(spark, **tables):
    return spark.createDataFrame([("f", f"{t}.txt", n, v) for t, own in tables.items() for n, v in enumerate(own, 1)], files.LINES)


def test_a_stray_quote_swallows_nothing(spark):
    rows = csvrows.split_rows(lines_df(spark, stops=["stop_id,stop_name,stop_lat,stop_lon", 'A,5" Pipe,1,2', "B,Bee,1,2", "C,Sea,1,2", "D,Dee,1,2"]))
    found = sorted((r["_row_number"], r["stop_id"], r["stop_name"]) for r in csvrows.raw_table(rows, "stops").collect())
    assert found == [(2, "A", '5" Pipe'), (3, "B", "Bee"), (4, "C", "Sea"), (5, "D", "Dee")]
    assert codes(files.row_shape(rows)) == []


def test_an_unclosed_quote_ends_at_a_bound(spark):
    own = ["stop_id,stop_name", "A,fine", 'B,"open', *(f"S{i},name {i}" for i in range(2000))]
    rows = csvrows.split_rows(lines_df(spark, stops=own, routes=["route_id", '"open']))
    assert [(r["stop_id"], r["_row_number"]) for r in csvrows.raw_table(rows, "stops").collect()] == [("A", 2)]
    [(code, row, context)] = codes(files.row_shape(rows))
    assert (code, row, context["columnIndex"], context["lineIndex"]) == ("csv_parsing_failed", None, "1", "2002") and context["parsedContent"].startswith("open\nS0,name 0\n") and len(context["parsedContent"]) == 4096
    assert [r["route_id"] for r in csvrows.raw_table(rows, "routes").collect()] == ["open\n"]
    # beyond the bound of a row nothing is put together
    joined = csvrows.join_quoted(lines_df(spark, stops=own), max_row=5000)
    assert sorted(((r["line_number"], r["value"]) for r in joined.collect())) == [(1, own[0]), (2, own[1]), (3, None)]


def test_blank_lines_before_the_header(spark):
    rows = csvrows.split_rows(lines_df(spark, stops=["", " \t", " stop_id , stop_name", "", "A,b", '""', '" "', "A,"]))
    assert [(r["_row_number"], r["stop_id"], r["stop_name"]) for r in csvrows.raw_table(rows, "stops").orderBy("_row_number").collect()] == [(5, "A", "b"), (8, "A", "")]
    assert codes(files.row_shape(rows)) == [("empty_row", 6, {}), ("invalid_row_length", 7, {"rowLength": "1", "headerCount": "2"})]


def test_headers(spark):
    heads = [
        ('"stop_id",stop_name', ["stop_id", "stop_name"]), ('"stop_i"d,x', ['"stop_i"d', "x"]), (' "stop_name" ,y', ['"stop_name"', "y"]), ("stop_name, stop_name ", ["stop_name", " stop_name "]), (" a , a ", ["a", "a"]),
        ("a,, ", ["a", "", ""]), ("x" * 1025 + ",b", ["", "b"]), ("x" * 1024 + ",b", ["x" * 1024, "b"]),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i long, value string")
    found = {r["i"]: r["c"] for r in df.select("i", csvrows.names_of(F.col("value")).alias("c")).collect()}
    assert [found[i] for i in range(len(heads))] == [want for _, want in heads]


def test_declared_fields(spark):
    rows = csvrows.split_rows(lines_df(spark, stop_times=["trip_id,timepoint,stop_id", "T,1,S"], stops=["stop_id", "A"]))
    bits = {t: csvrows.raw_table(rows, t).first()["_declared"] for t in ("stop_times", "stops")}
    for t, own in (("stop_times", {"trip_id", "timepoint", "stop_id"}), ("stops", {"stop_id"})):
        names = csvrows.TABLES[t].names
        assert {n for i, n in enumerate(names) if bits[t] >> i & 1} == own


def test_long_cells_by_table(spark):
    long = "x" * 4097
    rows = csvrows.split_rows(lines_df(spark, areas=["area_id,area_name", f"A,{long}"], stops=["stop_id,stop_name", f"A,{'😀' * 2048}", f"B,{'😀' * 2049}", "C,c"]))
    assert csvrows.raw_table(rows, "areas").count() == 1
    assert [r["stop_id"] for r in csvrows.raw_table(rows, "stops").collect()] == ["A"]
    assert [(c, x["columnIndex"], x["lineIndex"]) for c, _, x in codes(files.row_shape(rows))] == [("csv_parsing_failed", "1", "2")]
