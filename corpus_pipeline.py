"""The training corpus in five stages, each written as Parquet and read again by the next.

Every stage takes an empty table, rows that repeat, nulls in any column and extra columns of any name, which are carried
along in a struct; each docstring says what becomes of nulls and of equal rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphgrid.llm import bpe, jaccard, lines, mixing, outliers
from glyphgrid.llm.common import drop, maybe_in, table, written
from glyphgrid.llm.queries import tokenizer_file

ORACLE_SQL = None  # no SQL states the fit of the quality rules, the alignment or the encoding

#: The rule for near copies where no contract names another.
SHINGLE_WORDS, LIKENESS_PERCENT = 5, 80


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _columns(rows: DataFrame, docs: DataFrame, **other) -> DataFrame:
    """The struct taken apart into the columns of docs."""
    return rows.select(*[other.get(c, F.col("row").getField(c)).cast(f.dataType).alias(c) for c, f in zip(docs.columns, docs.schema.fields)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; null languages and sources are groups; equal rows are judged alike."""
    kept = outliers.judge(docs.select(_row(docs), "lang", "source", "text"), keep=("row",)).filter("_kept")
    return _columns(kept, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the blocks that an earlier one has; n_chars is counted anew. Null texts stay null, and rows equal in key and text lose the same."""
    out = lines.dedup(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that of least doc_id (null first), then of least text hash.

    Of rows equal in both one stays. Texts without words are linked with nothing and stay, equal ones included.
    """
    rows = docs.select(_row(docs), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    key = F.struct(F.col("id").isNotNull().alias("known"), "id", "th").alias("key")
    groups = jaccard.link(rows.select(key, "text"), key="key", words=SHINGLE_WORDS, percent=LIKENESS_PERCENT).filter("n_shingles > 0")
    marked = groups.groupBy("key.id", "key.th").agg(F.max(F.col("key") != F.col("component_id")).alias("copy"), F.count("*").alias("n"))
    marked, _ = written(marked.filter("copy or n > 1").select("id", "th", "copy"), "copies")
    both = [F.col("id"), F.col("th")]
    plain = rows.select("row", "id", "th")
    # Only rows that may be copies are shuffled.
    sure = maybe_in(plain, both, marked, both, inside=False).select("row")
    asked = maybe_in(plain, both, marked, both).alias("r").join(marked.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.th") == F.col("m.th")), "left")
    asked = asked.select("r.row", "r.id", "r.th", "m.copy")
    once = asked.filter("not copy").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return _columns(sure.unionByName(asked.filter("copy is null").select("row")).unionByName(once.select("row")), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as texts: whole documents for full rounds, the taken blocks for what is beyond. n_chars is counted anew.

    Null and empty texts go, having no words; a null source is a source; equal rows are documents of their own.
    """
    out = mixing.texts_taken(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and decoded text, beside its key, language and source. A null text is empty; other columns aren't kept."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), tokenizer_file("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("mixing", mixed), ("byte pairs", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop(spark, before)
        before = path
    return docs
