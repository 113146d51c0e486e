from pyspark.sql import functions as F


def evaluate(spark, f, rows, schema):
    """f of columns a, b, .. for each row of values, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").coalesce(1)
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.v for r in df.select("_i", f(*cols).alias("v")).orderBy("_i").collect()]
