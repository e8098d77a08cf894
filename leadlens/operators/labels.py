"""Code -> display label lookup.

A label table is a fixed dictionary (a dozen entries), so it is broadcast; codes
without a label keep their raw value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_table(df: DataFrame, mapping: dict[str, str], col: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame(list(mapping.items()), f"__code_{col} string, __label_{col} string")


def with_labels(df: DataFrame, mappings: dict[str, dict[str, str]], suffix: str = "_label") -> DataFrame:
    """Add ``<col>_label`` for every column named in ``mappings``."""
    out = df
    for col, mapping in mappings.items():
        t = label_table(df, mapping, col)
        out = (out.join(F.broadcast(t), out[col] == t[f"__code_{col}"], "left")
                  .withColumn(col + suffix, F.coalesce(F.col(f"__label_{col}"), F.col(col)))
                  .drop(f"__code_{col}", f"__label_{col}"))
    return out
