"""Small tables for the tests of the training-data operators."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs(spark, rows):
    """Rows of (id, text) or (id, text, lang) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clash(df):
    """The frame with more columns, under names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "fp", "mark", "doc", "row", "n", "start", "end", "key", "words", "score", "first", "component", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df


def groups(n, linked):
    """Least member of the group of each of n items, by pairs."""
    parent = list(range(n))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
