"""Kinds, severities, deduplication and display order of string rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stringloom.functions import lexicon as L
from stringloom.functions.classify import DEFER, base64_gate, base85_gate, kind_sql, url_encoded
from stringloom.functions.codecs import classify_rest
from stringloom.functions.dialect import SPARK

KEY = "blob_id"


@F.pandas_udf(StringType())
def _rest(value: pd.Series, base85: pd.Series, base64: pd.Series, url: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(value), dtype=object)
    for i in value.index[value.notna()]:
        out[i] = classify_rest(value[i], bool(base85[i]), bool(base64[i]), bool(url[i]))
    return out


#: Not deterministic for the optimiser, which else computes the kind again in every filter on it.
_rest_once = _rest.asNondeterministic()


def native_kind(value: str = "value") -> Column:
    """The kind by built-in functions alone; DEFER where bytes must be decoded to tell."""
    return F.expr(kind_sql(SPARK, value))


def with_kind(rows: DataFrame, value: str = "value", out: str = "kind") -> DataFrame:
    """rows with the kind of each value. Python sees the few undecided values, nulls for the others."""
    first = rows.withColumn("__k", native_kind(value))
    open_ = F.col("__k") == DEFER
    gate = lambda sql: F.when(open_, F.expr(sql)).otherwise(False)
    rest = _rest_once(F.when(open_, F.col(value)), gate(base85_gate(SPARK, value)), gate(base64_gate(SPARK, value)), gate(url_encoded(SPARK, value)))
    return first.withColumn("__rest", rest).withColumn(out, F.when(open_, F.col("__rest")).otherwise(F.col("__k"))).drop("__k", "__rest")


def severity(kind: Column) -> Column:
    """High, Medium, Low or Info; no kind is Info."""
    out = F.lit("Info")
    for name in ("Low", "Medium", "High"):
        out = F.when(kind.isin(*L.SEVERITY[name]), name).otherwise(out)
    return F.when(kind.isNull(), "Info").otherwise(out)


def priority(method: Column, display: bool = False) -> Column:
    out = F.lit(0)
    for n in (1, 2, 3):
        out = F.when(method.isin(*(m[0] for m in L.METHODS if m[1 + display] == n)), n).otherwise(out)
    return out


def top_per_offset(rows: DataFrame, display: bool = False) -> DataFrame:
    """One row for each offset of a blob: highest priority, longest, then method and value."""
    order = Window.partitionBy(KEY, "data_offset").orderBy(priority(F.col("method"), display).desc(), F.octet_length("value").desc(), "method", "value")
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def first_per_value(rows: DataFrame) -> DataFrame:
    """The first row of each normalised value in a blob; decoded scripts are exempt."""
    norm = F.trim(F.regexp_replace("value", r"\p{Cntrl}+$", ""))
    exempt = F.col("method") == "ScriptDecode"
    order = Window.partitionBy(KEY, norm, F.when(exempt, F.col("data_offset"))).orderBy("data_offset", "method", "value")
    return rows.withColumn("__rank", F.row_number().over(order)).where((F.col("__rank") == 1) | exempt).drop("__rank")


def notable(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n rows of each blob to look at first: severity High but XOR keys, by bucket and offset."""
    bucket = F.lit(5)
    for kind, at in L.NOTABLE_ORDER:
        bucket = F.when(F.col("kind") == kind, at).otherwise(bucket)
    high = rows.where((severity(F.col("kind")) == "High") & (F.col("kind") != "XorKey")).withColumn("bucket", bucket)
    order = Window.partitionBy(KEY).orderBy("bucket", "data_offset", "value")
    return high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
