"""The training-data queries of ``__spark_entry__``: one for each operator."""

from pyspark.sql import functions as F

from glyphgrid.llm import align, bpe, chat, extract, jaccard, lines, minhash, mixing, oracle, outliers, packed, search, shards, toxicity
from glyphgrid.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_outliers(spark, sf_dir):
    return outliers.verdicts(table(spark, sf_dir, "documents"))


def op2_lines(spark, sf_dir):
    return lines.digests(table(spark, sf_dir, "documents"))


def op3_packed_ids(spark, sf_dir):
    return packed.packed_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_html(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_minhash(spark, sf_dir):
    return minhash.edited_pairs(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), keep=("doc_id",))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return shards.shard_by_key(table(spark, sf_dir, "documents"))


def op10_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = turns.unionByName(planted).withColumn("parts", chat.as_parts(F.col("text")))
    return chat.digests(chat.format_conversations(rows))


def op11_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_align(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    return dict(oracle.SQL)
