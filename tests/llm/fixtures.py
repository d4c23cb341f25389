"""Awkward documents that every operator has to take: nulls, empty and long texts, ties, repeats, extra columns."""

from pyspark.sql import functions as F

AWKWARD = [
    (1, "The quick brown fox's jumping over the lazy dog, again and again.", "en", "s"),
    (2, None, "en", "s"),
    (3, "", None, None),
    (4, "  \t\n ", "en", "s"),
    (5, "The quick brown fox's jumping over the lazy dog, again and again.", "en", "s"),
    (6, "ŒUVRE ﬁne Straße 12345 ½ naïve é 中文字   end\r\n", "fr", "s"),
    (7, "x" * 30_000 + " " + "long words and more " * 4000, "en", "s"),
    (8, "*** $$$ !!! ###", "en", "s"),
    (9, "one", "en", "s"),
    (9, "one", "en", "s"),
    (None, "null id here and nothing else to be seen", None, None),
    (-7, "negative id, THE QUICK BROWN FOX'S", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark):
    """Extra columns clash with names that operators use inside."""
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    for name in ("shard", "bucket", "part", "n", "score", "component_id", "variant"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
