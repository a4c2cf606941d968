"""Comparisons row by row and reports as lines of text. Reports are formatted from aggregates of bounded size."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decisions import schema_tier


def cleaned(v):
    """A JSON value without null, {} and [] entries of objects, at any depth; the elements of lists all stay."""
    if isinstance(v, dict):
        kept = {k: cleaned(x) for k, x in v.items()}
        return {k: x for k, x in kept.items() if x is not None and x != {} and x != []}
    return [cleaned(x) for x in v] if isinstance(v, list) else v


def clean_json(c: Column) -> Column:
    """One text per JSON document whatever the order of its keys, cleaned; null for a text that is no JSON."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(cleaned(json.loads(t)), sort_keys=True, ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(c)


def compare_rows(ref: DataFrame, got: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, state): same, differs, only_ref or only_got, after cleaning both documents. Equal hashes count as equal."""
    a = ref.select(key, F.sha2(clean_json(F.col(doc)), 256).alias("__a"), F.lit(True).alias("__in_a"))
    b = got.select(key, F.sha2(clean_json(F.col(doc)), 256).alias("__b"), F.lit(True).alias("__in_b"))
    state = F.when(F.col("__in_b").isNull(), "only_ref").when(F.col("__in_a").isNull(), "only_got").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def error_counts(failures: DataFrame) -> DataFrame:
    """Failures by the first of errorMessage and errorKind that says something, else by ``httpStatus=``."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    what = F.coalesce(some("errorMessage"), some("errorKind"), F.concat(F.lit("httpStatus="), F.coalesce(F.col("httpStatus").cast("string"), F.lit("None"))))
    return failures.groupBy(what.alias("error")).agg(F.count("*").alias("n"))


def summary_lines(rows: DataFrame) -> DataFrame:
    """(ord, line): counts of the funnel, then one table line a schema tier, in order."""
    ok = F.col("outcome") == "success"
    g = rows.groupBy(schema_tier().alias("tier")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    total = g.agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum(F.when(F.col("tier") == "current", F.col("ok")).otherwise(0)).alias("cur"))
    item = lambda title, c: F.concat(F.lit(f"- {title}: **"), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("**"))
    head = total.select(F.posexplode(F.array(item("Decisions", "n"), item("Success", "ok"), item("Current schema", "cur"))).alias("ord", "line"))
    tiers = table_lines(g.select("tier", "n", "ok"), "tier").select((F.lit(10)).alias("ord"), "line")
    return head.unionByName(tiers)


def table_lines(rows: DataFrame, order: str) -> DataFrame:
    """(line): one line of a text table per row, in the order of a column; a missing value is shown as ?."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in rows.columns]
    return rows.orderBy(order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def manifest_of(rows: DataFrame, text: Column) -> DataFrame:
    """The rows with the first sixteen digits of the text's hash and its length."""
    return rows.select(*rows.columns, F.substring(F.sha2(text, 256), 1, 16).alias("prompt_hash"), F.length(text).cast("bigint").alias("chars"))


def report_text(lines: list[str], title: str) -> str:
    """A Markdown report of lines that came from bounded aggregates."""
    return "\n".join([f"# {title}", "", *lines, ""])

