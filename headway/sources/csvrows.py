"""Lines of CSV files to rows and cells, losing nothing.

A quote opens a quoted cell only where a cell begins. Within one, a doubled quote is a quote and a
line break is content. What stands between the closing quote and the comma is dropped if it is
padding; else the cell is literal text, its quotes included. Bare cells lose their padding,
quoted ones keep it. Blanks before an opening quote are passed over, unless the row would then
have another number of cells; then all its cells are taken as bare.

Whether a line begins within quotes depends on all lines before. A line is a function on two
states (outside, inside): constant, identity or exchange. Such functions compose, so they are
composed within blocks of lines first and then over blocks, one row each. A row whose cells can't
all be within the limit of a cell isn't put together; the table ends there, as it does at any cell
beyond the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TABLES

#: Characters (UTF-16 units) of a cell, of a name in the header, and of a row of several lines.
MAX_CELL, MAX_NAME, MAX_ROW = 4096, 1024, 1 << 20
#: Tables whose cells may be of any length.
UNLIMITED = ("areas",)
#: Lines of a file that are ordered in one task.
BLOCK_LINES = 100_000
#: Padding: characters up to the blank.
PADDING = "".join(map(chr, range(33)))
#: Patterns, all possessive so that long rows need no stack. Content of a quoted cell: up to a lone quote or the end.
INNER = '[^"]*+(?:""[^"]*+)*+'
CELLS = f'(?:"{INNER}"[^,]*+(?:,|\\z)|(?!")[^,]*+(?:,|\\z))*+'
#: Lines that end within quotes if they begin outside, and inside of them.
OPENS, STAYS_OPEN = f'^{CELLS}"{INNER}\\z', f'^{INNER}(?:\\z|"[^,]*+,{CELLS}"{INNER}\\z)'
BLANKS = "[\\x00-\\x09\\x0b\\x0c\\x0e-\\x20]*+"


def padded(c: Column) -> Column:
    """c without padding on either side."""
    return F.btrim(c, F.lit(PADDING))


def join_quoted(lines: DataFrame, block: int = BLOCK_LINES, max_row: int = MAX_ROW) -> DataFrame:
    """Lines (feed_id, filename, line_number, value) with quoted line breaks put together; the number is that of a row's last line.

    A row of more than max_row characters has a null value and the number of its first line. Files
    without a line that ends within quotes pass as they are.
    """
    keys = ["feed_id", "filename"]
    quoted = F.col("value").contains('"')
    opens = F.when(quoted, F.col("value").rlike(OPENS)).otherwise(F.lit(False))
    stays = F.when(quoted, F.col("value").rlike(STAYS_OPEN)).otherwise(F.lit(True))
    marked = lines.withColumns({"opens": opens, "stays": stays})
    # a row for each file, no more than the driver lists to read them: broadcast, as a shuffle by file would leave a large one to one task
    several = F.broadcast(marked.where("opens").select(*keys).distinct())
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)

    def composed(df: DataFrame, over) -> DataFrame:
        """Adds turns (exchanges so far) and fixed (state and turns at the last constant) of the functions opens, stays."""
        df = df.withColumn("turns", F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(over))
        constant = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").cast("int").alias("to"), F.col("turns").alias("at")))
        return df.withColumn("fixed", F.last(constant, ignorenulls=True).over(over)).drop("opens", "stays")

    def after(start: Column) -> Column:
        """The state after a row, from that before the first."""
        turns, fixed = F.col("turns"), F.col("fixed")
        return F.when(fixed.isNull(), (start + turns) % 2).otherwise((fixed["to"] + turns - fixed["at"]) % 2)

    by = W.partitionBy(*keys, "block").orderBy("line_number")
    rows = marked.join(several, keys, "left_semi").withColumn("block", F.floor(F.col("line_number") / block))
    rows = composed(rows, by)

    ends = lambda start: F.max_by(after(F.lit(start)), "line_number")
    ended = lambda start: F.count_if(after(F.lit(start)) == 0)
    blocks = rows.groupBy(*keys, "block").agg((ends(0) == 1).alias("opens"), (ends(1) == 1).alias("stays"), ended(0).alias("ended0"), ended(1).alias("ended1"))
    order = W.partitionBy(*keys).orderBy("block")
    blocks = composed(blocks, order).withColumn("end", after(F.lit(0))).withColumn("start", F.coalesce(F.lag("end").over(order), F.lit(0)))
    own = F.when(F.col("start") == 0, F.col("ended0")).otherwise(F.col("ended1"))
    blocks = blocks.withColumn("ended", F.coalesce(F.sum(own).over(before(order)), F.lit(0)))
    rows = rows.join(blocks.select(*keys, "block", "start", "ended"), [*keys, "block"]).withColumn("open", after(F.col("start")))
    rows = rows.withColumn("row", F.col("ended") + F.coalesce(F.sum(1 - F.col("open")).over(before(by)), F.lit(0)))

    size = F.sum(F.length("value") + 1)
    long = rows.groupBy(*keys, "row").agg(size.alias("size"), F.min("line_number").alias("line_number")).where(F.col("size") > max_row)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "value"))), lambda s: s["value"])
    short = rows.join(long.select(*keys, "row"), [*keys, "row"], "left_anti")
    whole = short.groupBy(*keys, "row").agg(F.max("line_number").alias("line_number"), F.array_join(texts, "\n").alias("value"))
    cut = long.select(*keys, "line_number", F.lit(None).cast("string").alias("value"))
    names = lines.columns
    return lines.join(several, keys, "left_anti").unionByName(whole.select(names)).unionByName(cut.select(names))


def cells_of(line: Column) -> Column:
    """The cells of a row."""
    # each cell behind a comma, so that an empty row has one
    text = F.concat(F.lit(","), line)
    literal = F.regexp_extract_all(text, F.lit(f',("{INNER}(?:"[^,]*+)?|[^,"][^,]*+|)'), F.lit(1))
    skipping = F.regexp_extract_all(text, F.lit(f',({BLANKS}"{INNER}(?:"[^,]*+)?|[^,]*+)'), F.lit(1))
    bare = F.transform(literal, lambda c: padded(opened(c)))
    return F.when(~line.contains('"'), F.split(padded(line), "[\\x00-\\x20]*+,[\\x00-\\x20]*+")).when(
        F.size(literal) == F.size(skipping), F.transform(skipping, resolved)
    ).otherwise(bare)


def parts(c: Column) -> tuple[Column, Column, Column]:
    """Of a cell that begins with a quote (and blanks before it): content, whether it is closed, and what stands behind."""
    part = lambda i: F.regexp_extract(c, f'^{BLANKS}"({INNER})("?)([\\s\\S]*)$', i)
    return F.replace(part(1), F.lit('""'), F.lit('"')), part(2) == '"', part(3)


def opened(c: Column) -> Column:
    """A cell as text: its quotes gone if it begins with one."""
    content, _, rest = parts(c)
    return F.when(c.startswith('"'), F.concat(content, rest)).otherwise(c)


def resolved(c: Column) -> Column:
    """A cell's value. One that is never closed runs to the end of its row, whose line break it takes in."""
    content, closed, rest = parts(c)
    literal = F.rtrim(F.concat(F.lit('"'), content, F.lit('"'), rest), F.lit(PADDING))
    value = F.when(~closed, F.concat(content, F.lit("\n"))).when(padded(rest) == "", content).otherwise(literal)
    return F.when(c.rlike(f'^{BLANKS}"'), value).otherwise(padded(c))


def names_of(line: Column) -> Column:
    """The names of a header: as cells_of, but blanks before a quote aren't passed over, names beyond MAX_NAME are empty, and
    padding stays where names would be alike without it."""
    text = F.concat(F.lit(","), line)
    literal = F.regexp_extract_all(text, F.lit(f',("{INNER}(?:"[^,]*+)?|[^,"][^,]*+|)'), F.lit(1))

    def name(c: Column) -> Column:
        content, closed, rest = parts(c)
        reverted = closed & (padded(rest) != "")
        return F.when(~c.startswith('"'), c).when(reverted, F.rtrim(F.concat(F.lit('"'), content, F.lit('"'), rest), F.lit(PADDING))).otherwise(F.concat(content, rest))

    names = F.transform(literal, lambda c: F.when(units(name(c)) > MAX_NAME, F.lit("")).otherwise(name(c)))
    short = F.transform(names, padded)
    told = lambda a: F.size(F.array_distinct(F.filter(a, lambda x: padded(x) != "")))
    return F.when(told(short) < told(names), names).otherwise(short)


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.octet_length(F.encode(c, "UTF-16BE")) / 2)


def records(lines: DataFrame) -> DataFrame:
    """lines -> (feed_id, table, _row_number, value) of known tables; blank lines are left out. A null value is a row that was cut."""
    known = F.lower(F.regexp_replace("filename", "(?i)\\.txt$", ""))
    own = join_quoted(lines.where("value is not null")).where(known.isin([n for n in TABLES if n != "zones"]) & F.lower("filename").endswith(".txt"))
    return own.where(F.col("value").isNull() | (padded(F.col("value")) != "")).select("feed_id", known.alias("table"), F.col("line_number").alias("_row_number"), "value")


def over_limit(cells: Column, table: Column) -> Column:
    """The place (from 0) of the first cell beyond the limit, or null."""
    lengths = F.transform(cells, lambda c: (units(c) > MAX_CELL).cast("int"))
    return F.when(~table.isin(*UNLIMITED), F.nullif(F.array_position(lengths, 1), F.lit(0)) - 1).cast("int")


def headers_of(records: DataFrame) -> DataFrame:
    """records() -> a row for each file: feed_id, table, header, first (its row), at, declared, stop.

    The header is the first row. at: for each field of the table its place in the header (from 1), 0 where
    it isn't there; declared: the same as bits. stop: the first row with a cell beyond the limit.
    """
    fields = F.create_map(*(x for t in TABLES.values() for x in (F.lit(t.name), F.array(*(F.lit(n) for n in t.names)))))
    cut = F.col("value").isNull() | (F.octet_length("value") > MAX_CELL) & over_limit(cells_of(F.col("value")), F.col("table")).isNotNull()
    heads = records.groupBy("feed_id", "table").agg(F.min_by("value", "_row_number").alias("head"), F.min("_row_number").alias("first"), F.min(F.when(cut, F.col("_row_number"))).alias("stop"))
    heads = heads.withColumn("header", names_of(F.coalesce("head", F.lit(""))))
    at = F.transform(F.element_at(fields, F.col("table")), lambda n: F.array_position("header", n).cast("int"))
    bits = F.transform(F.col("at"), lambda p, i: F.when(p > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return heads.withColumn("at", at).withColumn("declared", F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x + y)).drop("head")


def split_records(records: DataFrame, headers: DataFrame) -> DataFrame:
    """records() and headers_of() -> feed_id, table, _row_number, cells, header, at, declared, cut, without header rows.

    A table ends at its first row with a cell beyond the limit, where cut has the cell's place (-1 for a row
    that wasn't put together); cut is null elsewhere. The headers, one for each file, are broadcast, so a large file stays dealt over tasks.
    """
    rows = records.join(F.broadcast(headers), ["feed_id", "table"]).where("(_row_number > first or _row_number = stop) and (stop is null or _row_number <= stop)")
    rows = rows.withColumn("cells", F.coalesce(cells_of(F.col("value")), F.array().cast("array<string>")))
    cut = F.when(F.col("_row_number") == F.col("stop"), F.coalesce(over_limit(F.col("cells"), F.col("table")), F.lit(-1)))
    return rows.select("feed_id", "table", "_row_number", "cells", "header", "at", "declared", cut.alias("cut"))


def split_rows(lines: DataFrame) -> DataFrame:
    """Lines of files -> the rows of known tables, see split_records."""
    found = records(lines)
    return split_records(found, headers_of(found))


def raw_table(rows: DataFrame, table: str) -> DataFrame:
    """split_rows() -> the text columns of one table, and _declared: which of its fields the file's header has, as bits.

    Rows of a wrong length are left out, and so is one that was cut.
    """
    own = rows.where((F.col("table") == table) & (F.size("cells") == F.size("header")) & F.col("cut").isNull() & ~lone_empty(F.col("cells")))
    cells = [F.get("cells", F.get("at", F.lit(i)) - 1).alias(f.name) for i, f in enumerate(TABLES[table].fields)]
    return own.select("feed_id", "_row_number", *cells, F.col("declared").alias("_declared"))


def lone_empty(cells: Column) -> Column:
    """Whether a row is one empty cell."""
    return (F.size(cells) == 1) & (F.get(cells, F.lit(0)) == "")
