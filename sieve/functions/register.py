"""SQL names of functions: spark.sql(...) can use them after ``register``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions.hashing import fnv64_udf
from sieve.operators.mime import parse_udf


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("token", T.StringType())]))
class Tokens:
    """tokens(text): a row for each token of the feature pattern."""

    def eval(self, text: str):
        for k, m in enumerate(re.finditer(r"[^\W_][\w\-.@]{1,48}", (text or "").lower())):
            yield k, m.group()


@F.pandas_udf(T.LongType())
def fnv32_sql(values: pd.Series) -> pd.Series:
    def one(v: str) -> int:
        h = 2166136261
        for k in range(0, len(b := v.encode("utf-16-le", "surrogatepass")), 2):
            h = ((h ^ (b[k] | b[k + 1] << 8)) * 16777619) & 0xFFFFFFFF
        return h

    return values.fillna("").map(one)


def register(spark: SparkSession) -> None:
    spark.udf.register("sieve_fnv32", fnv32_sql)
    spark.udf.register("sieve_fnv64", fnv64_udf)
    spark.udf.register("sieve_parse_message", parse_udf)
    spark.udtf.register("sieve_tokens", Tokens)
