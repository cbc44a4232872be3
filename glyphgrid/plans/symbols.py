"""Symbols of streams: the characters of whole texts."""

from pyspark.sql import functions as F


def counts(spark, sf_dir):
    """How often each character occurs in all texts. Equal characters of a text are added up before the shuffle, by Spark's partial sums."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").filter(F.length("text") > 0)
    return texts.select(F.explode(F.split("text", "")).alias("sym")).groupBy("sym").agg(F.count("*").alias("cnt"))


QUERIES = {
    "o8_8_symbols": (counts, "SELECT sym, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS sym FROM documents) t WHERE sym <> '' GROUP BY sym"),
}
