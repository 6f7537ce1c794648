"""Data-quality rules. Every rule returns rows (check, subject, ok, message).

Row rules list what fails; table rules return one row either way, so that a run always shows
what was looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, check: str | Column, subject: Column, message: Column, ok: Column | None = None) -> DataFrame:
    name = F.lit(check) if isinstance(check, str) else check
    return df.select(
        name.alias("check"),
        subject.cast("string").alias("subject"),
        (F.lit(False) if ok is None else ok).alias("ok"),
        message.alias("message"),
    )


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """All rules as one report, so a run shows every problem and not only the first."""
    return reduce(DataFrame.unionByName, reports)


def unique_key(df: DataFrame, keys: Sequence[str], check: str = "unique_key") -> DataFrame:
    """Keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    subject = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return _rows(repeated, check, subject, F.concat(F.lit("occurs "), "_n", F.lit(" times")))


def required_fields(
    df: DataFrame, subject: str, required: Sequence[str], body: str | None = None,
    allowed: Mapping[str, Sequence[str]] | None = None, check: str = "required_fields",
) -> DataFrame:
    """Missing fields, blank bodies and values outside a fixed list, one row per problem."""
    found = F.explode(field_problems(required, body, allowed))
    return _rows(df.withColumn("_problem", found), check, F.col(subject), F.col("_problem"))


def field_problems(
    required: Sequence[str], body: str | None = None, allowed: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """What ``required_fields`` finds in a row, as an array: all rules of a table in one expression."""
    problems = [
        F.when(F.col(field).isNull(), F.lit(f"missing field '{field}'")) for field in required
    ]
    if body:
        problems.append(F.when(F.trim(F.coalesce(F.col(body), F.lit(""))) == "", F.lit("empty body")))
    for field, values in (allowed or {}).items():
        known = F.coalesce(F.col(field).isin(*values), F.lit(False))
        shown = F.coalesce(F.col(field).cast("string"), F.lit("NULL"))
        problems.append(F.when(~known, F.concat(F.lit(f"unknown {field} "), shown)))
    return F.array_compact(F.array(*problems))


def listed_problems(
    df: DataFrame, subject: str, problems: str, check: str = "required_fields"
) -> DataFrame:
    """One row per entry of a column of problems."""
    return _rows(df.withColumn("_problem", F.explode(problems)), check, F.col(subject), F.col("_problem"))


def stated_numbers(text: Column) -> Column:
    """The whole numbers that stand as words of their own in a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), F.lit(1)))


def foreign_key(
    df: DataFrame, subject: str, column: str, target: DataFrame, target_key: str,
    check: str = "foreign_key",
) -> DataFrame:
    """Rows whose non-null reference has no target."""
    keys = target.select(F.col(target_key).alias("_key")).distinct()
    used = df.filter(F.col(column).isNotNull())
    missing = used.join(keys, F.col(column) == F.col("_key"), "left_anti")
    message = F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(" has no target"))
    return _rows(missing, check, F.col(subject), message)


def bidirectional(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str,
    left_name: str = "left", right_name: str = "right", check: str = "bidirectional",
) -> DataFrame:
    """References without a target, and targets nothing refers to."""
    a = left.select(F.col(left_key).alias("_k")).filter("_k IS NOT NULL").distinct()
    b = right.select(F.col(right_key).alias("_k")).filter("_k IS NOT NULL").distinct()
    no_target = a.join(b, "_k", "left_anti")
    no_source = b.join(a, "_k", "left_anti")
    return union_reports(
        [
            _rows(no_target, check, F.col("_k"), F.lit(f"{left_name} has no {right_name}")),
            _rows(no_source, check, F.col("_k"), F.lit(f"{right_name} has no {left_name}")),
        ]
    )


def states_value(
    df: DataFrame, subject: str, text: str, value: str, check: str = "text_states_value"
) -> DataFrame:
    """Texts that do not contain their linked whole number as a word of its own."""
    number = F.col(value).cast("string")
    stated = F.expr(f"`{text}` RLIKE concat('\\\\b', CAST(`{value}` AS STRING), '\\\\b')")
    wrong = df.filter(F.col(value).isNotNull() & ~stated)
    return _rows(wrong, check, F.col(subject), F.concat(F.lit("does not state "), number))


def lists_value(
    df: DataFrame, subject: str, numbers: str, value: str, check: str = "text_states_value"
) -> DataFrame:
    """As ``states_value`` for whole numbers of 0 and more, from the ``stated_numbers`` of a text read before."""
    number = F.col(value).cast("string")
    wrong = df.filter(F.col(value).isNotNull() & ~F.coalesce(F.array_contains(numbers, number), F.lit(False)))
    return _rows(wrong, check, F.col(subject), F.concat(F.lit("does not state "), number))


def states_decimal(
    df: DataFrame, subject: str, text: str, value: str, unit: str, check: str = "text_states_decimal"
) -> DataFrame:
    """Whether texts state a value both rounded with its unit and exactly, with a decimal comma."""
    rounded = F.concat(F.format_string("%.0f", F.rint(F.col(value))), F.lit(f" {unit}"))
    exact = F.translate(F.format_string("%.2f", F.col(value)), ".", ",")
    forms = F.explode(F.array(rounded, exact))
    stated = F.instr(F.col(text), F.col("_form")) > 0
    return _rows(
        df.withColumn("_form", forms), check, F.col(subject),
        F.concat(F.lit("states "), F.col("_form")), ok=stated,
    )


def domain(df: DataFrame, subject: str, rules: Mapping[str, str], check: str = "domain") -> DataFrame:
    """Rows that break a boolean SQL rule; as with CHECK, an unknown outcome passes."""
    broken = [
        F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(f"{name}: {rule}"))
        for name, rule in rules.items()
    ]
    found = df.withColumn("_problem", F.explode(F.array_compact(F.array(*broken))))
    return _rows(found, check, F.col(subject), F.col("_problem"))


def derived_equal(
    df: DataFrame, subject: str, minutes: str, start: str, end: str, check: str = "derived_equal"
) -> DataFrame:
    """Rows whose stored minutes differ from the distance of their two instants."""
    seconds = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    wrong = df.filter(F.col(minutes) * 60 != seconds)
    message = F.concat(F.lit("stored "), F.col(minutes), F.lit(" min, actual "), seconds, F.lit(" s"))
    return _rows(wrong, check, F.col(subject), message)


def conditional_null(
    df: DataFrame, subject: str, condition: str, column: str, must_be_null: bool,
    check: str = "conditional_null",
) -> DataFrame:
    """Rows under ``condition`` whose column is (not) NULL against the rule."""
    value = F.col(column)
    wrong = df.filter(F.expr(condition) & (value.isNotNull() if must_be_null else value.isNull()))
    expected = "must be NULL" if must_be_null else "must not be NULL"
    return _rows(wrong, check, F.col(subject), F.lit(f"{column} {expected} when {condition}"))


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Actual against expected rows of every table."""
    def one(name: str) -> DataFrame:
        count = F.count("*")
        found = tables[name].agg(count.alias("_n"))
        message = F.concat("_n", F.lit(f" rows, expected {expected[name]}"))
        return _rows(found, "row_counts", F.lit(name), message, ok=F.col("_n") == expected[name])

    return union_reports([one(name) for name in expected])


def span(df: DataFrame, name: str, ts: str, first: str, last: str) -> DataFrame:
    """Whether the instants of a table reach exactly from ``first`` to ``last``."""
    found = df.agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    ok = (F.col("_first") == F.lit(first).cast("timestamp_ntz")) & (
        F.col("_last") == F.lit(last).cast("timestamp_ntz")
    )
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("_first", "_last")]
    return _rows(found, "span", F.lit(name), F.concat_ws(" to ", *shown),
                 ok=F.coalesce(ok, F.lit(False)))
