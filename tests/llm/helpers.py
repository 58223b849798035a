"""Small tables with the cases every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PLAIN = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, PLAIN, "en", "src0", 1),
        (2, None, "en", "src0", None),
        (3, "", None, "src1", 0),
        (4, " \t\n ", "de", None, 3),
        (5, LONG, "fr", "src0", len(LONG)),
        (6, PLAIN, "en", "src0", 1),
        (6, PLAIN, "en", "src0", 1),
        (None, "Une phrase sans identité.", None, None, None),
        (8, "one two", "en", "src0", 7),
        (9, "Élève 123 %%% \u0000 x", "fr", "src2", 9),
        (10, "x" * 5000, "en", "src0", 5000),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """df with columns named like those that an operator adds."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("old").alias(n) for n in names])
