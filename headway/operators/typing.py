"""Typing: text tables to typed tables, with notices for every cell that is missing or wrong.

One select over each table: every field of the schema gives its typed column and a list of its
problems. Rows with an error leave the typed table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..notices import context_of
from ..schema import SPARK_TYPES, Field, Table

PARSERS = {
    "date": ("invalid_date", cells.to_date), "time": ("invalid_time", cells.to_seconds), "color": ("invalid_color", cells.to_color), "int": ("invalid_integer", cells.to_int), "enum": ("invalid_integer", cells.to_int),
    "float": ("invalid_float", cells.to_double), "latitude": ("invalid_float", cells.to_double), "longitude": ("invalid_float", cells.to_double), "decimal": ("invalid_float", cells.to_decimal), "amount": ("invalid_float", cells.to_decimal),
    "currency": ("invalid_currency", cells.to_currency), "language": ("invalid_language_code", cells.to_language), "timezone": ("invalid_timezone", cells.to_timezone), "url": ("invalid_url", cells.to_url), "email": ("invalid_email", cells.to_email),
}


@dataclass(frozen=True)
class Problem:
    when: Column
    code: str
    severity: str
    field: str
    value: Column

    def cell(self) -> Column:
        return F.when(self.when, F.struct(F.lit(self.code).alias("code"), F.lit(self.severity).alias("severity"), F.lit(self.field).alias("field"), self.value.cast("string").alias("value")))


problem = Problem


def any_error(found: list[Problem]) -> Column:
    out = F.lit(False)
    for p in found:
        if p.severity == "ERROR":
            out = out | F.coalesce(p.when, F.lit(False))
    return out


def typed(f: Field, text: Column) -> Column:
    value = PARSERS[f.type][1](text) if f.type in PARSERS else text
    if f.type == "enum":
        value = F.when(value.isNotNull() & ~value.isin(list(f.values)), min(0, *f.values) - 1).otherwise(value)
    return value


def field_problems(f: Field, raw: Column, text: Column, value: Column) -> list[Problem]:
    """raw: the cell as read; text: trimmed, null where empty; value: typed."""
    out = []
    if f.presence in ("required", "recommended"):
        out.append(problem(text.isNull(), f"missing_{f.presence}_field", "ERROR" if f.presence == "required" else "WARNING", f.name, F.lit(None)))
    out.append(problem(raw.contains("�"), "invalid_character", "ERROR", f.name, raw))
    out.append(problem(raw.contains("\n") | raw.contains("\r"), "new_line_in_value", "ERROR", f.name, raw))
    out.append(problem(raw != cells.java_trim(raw), "leading_or_trailing_whitespaces", "WARNING", f.name, raw))
    if f.type == "id":
        out.append(problem(text.rlike("[^\\x20-\\x7e]"), "non_ascii_or_non_printable_char", "WARNING", f.name, text))
    if f.type in PARSERS:
        out.append(problem(text.isNotNull() & value.isNull(), PARSERS[f.type][0], "ERROR", f.name, text))
    if f.type == "enum":
        out.append(problem(value == min(0, *f.values) - 1, "unexpected_enum_value", "WARNING", f.name, text))
    limit = {"latitude": 90.0, "longitude": 180.0}.get(f.type)
    if limit:
        out.append(problem(F.isnan(value) | (value < -limit) | (value > limit), "number_out_of_range", "ERROR", f.name, text))
    elif f.bounds:
        nan = F.isnan(value) if f.type == "float" else F.lit(False)
        fine = {"non_negative": value >= 0, "positive": value > 0, "non_zero": value != 0}[f.bounds]
        out.append(problem(value.isNotNull() & (nan | ~fine), "number_out_of_range", "ERROR", f.name, text))
    return out


def type_table(raw: DataFrame, table: Table, declared: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """raw (feed_id, _row_number and text columns) -> (typed rows without errors, notices).

    Columns that raw lacks are null; unknown ones are dropped, but for _declared (see sources.csvrows). declared names the columns of the
    header where raw has more; a recommended column that is not declared is reported for each row.
    """
    names = set(raw.columns) if declared is None else set(declared)
    keys = ["feed_id", "_row_number", *(c for c in ("_declared",) if c in raw.columns)]
    rows = raw.select(*keys, *(F.col(f.name) if f.name in names else F.lit(None).cast("string").alias(f.name) for f in table.fields))
    rows = rows.select("*", *(F.nullif(cells.java_trim(F.col(f.name)), F.lit("")).alias(f"_t_{f.name}") for f in table.fields))
    rows = rows.select("*", *(typed(f, F.col(f"_t_{f.name}")).cast(SPARK_TYPES.get(f.type, "string")).alias(f"_v_{f.name}") for f in table.fields))
    found = [p for f in table.fields for p in field_problems(f, F.col(f.name), F.col(f"_t_{f.name}"), F.col(f"_v_{f.name}"))]
    rows = rows.withColumn("_error", any_error(found))
    late = []
    for f in table.fields:
        if f.mixed_case:
            late.append(problem(~F.col("_error") & cells.mixed_case_missing(F.col(f"_t_{f.name}")), "mixed_case_recommended_field", "WARNING", f.name, F.col(f"_t_{f.name}")))
        if f.end_of:
            start, end = F.col(f"_v_{f.end_of}"), F.col(f"_v_{f.name}")
            late.append(problem(start > end, "start_and_end_range_out_of_order", "ERROR", f.name, end))
            if not f.may_equal:
                late.append(problem(start == end, "start_and_end_range_equal", "ERROR", f.name, end))
        if f.currency:
            amount = F.col(f"_v_{f.name}")
            digits = F.when(amount.contains("."), F.length(F.substring_index(amount, ".", -1))).otherwise(0)
            late.append(problem(digits != cells.fraction_digits(F.col(f"_v_{f.currency}")), "invalid_currency_amount", "ERROR", f.name, amount))
    # exploded as they are and filtered then: lambdas over the array would not be compiled
    each = rows.select("feed_id", "_row_number", F.explode(F.array(*(p.cell() for p in found + late))).alias("p")).where("p is not null")
    messages = each.select(
        "feed_id", "p.code", "p.severity", F.lit(table.file).alias("filename"), F.col("_row_number").cast("long").alias("row_number"), context_of({"fieldName": F.col("p.field"), "fieldValue": F.col("p.value")}).alias("context")
    )
    values = rows.where(~(F.col("_error") | any_error(late))).select(*keys, *(F.col(f"_v_{f.name}").alias(f.name) for f in table.fields))
    return values, messages


def failed_feeds(found: DataFrame, table: Table) -> DataFrame:
    """Feeds whose table lost rows: feed_id, table, status."""
    return found.where("severity = 'ERROR'").select("feed_id").distinct().select("feed_id", F.lit(table.name).alias("table"), F.lit("UNPARSABLE_ROWS").alias("status"))


