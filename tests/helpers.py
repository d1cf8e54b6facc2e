"""Evaluate a column expression on a few rows."""

from pyspark.sql import functions as F


def evaluate(spark, values, fn, names=("a",)):
    """`fn(*columns)` over the given rows; scalars are taken as one-column rows."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    out = df.select("i", fn(*[F.col(n) for n in names]).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]
