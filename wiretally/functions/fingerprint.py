"""Column functions that fingerprint SQL text: normal form, tables, operations, complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions.screening import ascii_boundary, count_of

_BLANKS = " \t\n\r\f\x0b"
OPERATIONS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
AGGREGATES = ["count", "sum", "avg", "min", "max", "group_concat"]
_NUMBER = r"(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])"
_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
_TABLE_REF = rf"(?i)(?<![0-9A-Za-z_])(?:from|join)\s+({_NAME}(?:\.{_NAME})?)"


def normalize_sql(query: Column) -> Column:
    """Lower-case template: numbers, then ``'…'``, then ``"…"`` to ``?``, blanks collapsed."""
    text = F.lower(F.btrim(query, F.lit(_BLANKS)))
    text = F.regexp_replace(text, _NUMBER, "?")
    text = F.regexp_replace(text, r"'[^']*'", "?")
    text = F.regexp_replace(text, r'"[^"]*"', "?")
    return F.regexp_replace(text, r"\s+", " ")


def fingerprint(query: Column) -> Column:
    return F.md5(normalize_sql(query))


def table_names(query: Column) -> Column:
    refs = F.regexp_extract_all(query, F.lit(_TABLE_REF), F.lit(1))
    return F.array_distinct(
        F.transform(refs, lambda r: F.lower(F.substring_index(r, ".", -1)))
    )


def operations(query: Column) -> Column:
    tests = [
        F.when(query.rlike("(?i)" + ascii_boundary(rf"\b{op.lower()}\b")), F.lit(op))
        for op in OPERATIONS
    ]
    return F.array_compact(F.array(*tests))


def join_count(query: Column) -> Column:
    return F.regexp_count(query, F.lit("(?i)" + ascii_boundary(r"\bjoin\b"))).cast("int")


def complexity(query: Column) -> Column:
    """Static cost score; keyword tests are plain substring tests."""
    low = F.lower(query)
    points = [
        F.when(low.contains(word), F.lit(score)).otherwise(F.lit(0.0))
        for word, score in [("select", 1.0), ("insert", 1.5), ("update", 2.0), ("delete", 2.0)]
        + [(agg, 0.3) for agg in AGGREGATES]
        + [("order by", 0.2), ("group by", 0.3), ("having", 0.4)]
    ]
    points.append(join_count(query) * 0.5)
    points.append(F.greatest(count_of(low, "select") - 1, F.lit(0)) * 1.0)
    points.append(count_of(low, "union") * 0.5)
    return reduce(lambda a, b: a + b, points)


def parameters(query: Column) -> Column:
    """Array of parameter descriptions: numbers first, then quoted strings."""
    numbers = F.transform(
        F.regexp_extract_all(query, F.lit(f"({_NUMBER})"), F.lit(1)),
        lambda v, i: F.struct(
            F.concat(F.lit("param_num_"), i.cast("string")).alias("name"),
            F.lit("numeric").alias("kind"),
            v.cast("double").alias("min_value"),
            v.cast("double").alias("max_value"),
            F.lit("uniform").alias("distribution"),
            F.lit(1).alias("cardinality"),
        ),
    )
    strings = F.transform(
        F.regexp_extract_all(query, F.lit(r"'([^']*)'"), F.lit(1)),
        lambda v, i: F.struct(
            F.concat(F.lit("param_str_"), i.cast("string")).alias("name"),
            F.lit("string").alias("kind"),
            F.lit(None).cast("double").alias("min_value"),
            F.lit(None).cast("double").alias("max_value"),
            F.lit("categorical").alias("distribution"),
            F.lit(1).alias("cardinality"),
        ),
    )
    return F.concat(numbers, strings)


def sql_operation(query: Column) -> Column:
    head = F.upper(F.btrim(query, F.lit(_BLANKS)))
    return reduce(
        lambda acc, op: F.when(head.startswith(op), F.lit(op)).otherwise(acc),
        ["DELETE", "UPDATE", "INSERT", "SELECT"],
        F.lit("OTHER"),
    )


def primary_table(query: Column) -> Column:
    """Word after the first ``from``, else ``into``, else ``update``; else ``unknown``."""
    low = F.lower(query)

    def after(keyword: str) -> Column:
        between = F.get(F.split(low, keyword, 3), F.lit(1))
        word = F.regexp_extract(between, r"(\S+)", 1)
        return F.when(word != "", word)

    return F.coalesce(after("from "), after("into "), after("update "), F.lit("unknown"))


def truncate(text: Column, n: int, *, ellipsis: bool = False) -> Column:
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text) if ellipsis else cut


def age_text(ts: Column, as_of: Column) -> Column:
    """``N days/hours/minutes ago``; whole days first, an exact hour still counts in minutes."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    return (
        F.when(ts.isNull(), F.lit("Unknown"))
        .when(days > 0, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(rest > 3600, F.concat(F.floor(rest / 3600).cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(rest / 60).cast("string"), F.lit(" minutes ago")))
    )
