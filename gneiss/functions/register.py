"""Functions for SQL, under their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.text import clean_string


def register(spark: SparkSession) -> list[str]:
    """Registers clean_text, normalize_cell, dense_escape and token_chars for use in SQL; Arrow batches, not rows."""
    from gneiss.plans import codec

    each = {"clean_text": clean_string, "normalize_cell": codec.normalize, "dense_escape": codec.escape}
    for name, f in each.items():
        spark.udf.register(name, _scalar(f, T.StringType()))
    spark.udf.register("token_chars", _scalar(codec.token_chars, T.IntegerType()))
    return [*each, "token_chars"]


def _scalar(f, kind):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, kind)
