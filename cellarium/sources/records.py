"""Order records, ``|``-delimited, as a typed table; and tables as batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.codec import compact_date

#: Fields of an order record in their order, with their types.
ORDER_FIELDS = [
    ("orderkey", "string"), ("custkey", "bigint"), ("orderstatus", "string"), ("totalprice", "double"), ("orderdate", "date"),
    ("orderpriority", "string"), ("clerk", "string"), ("shippriority", "int"), ("comment", "string"),
]


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Orders with the date as the number yyyyMMdd; fields that can't be read are NULL."""
    fields = F.split("value", r"\|")
    typed = [F.get(fields, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(ORDER_FIELDS)]
    rows = spark.read.text(path).select(*typed)
    return rows.withColumn("orderdate", compact_date(F.col("orderdate")))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
