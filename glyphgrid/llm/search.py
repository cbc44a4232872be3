"""Ranked lexical search: postings in term buckets, integer scores, the best documents of each item.

Terms are runs of ASCII letters and digits and of all other characters above ASCII; only A-Z are lower-cased.

The index has one row for each term of a block of documents (some megabytes of their text), with the
documents, how often each holds the term, and how many terms each has. Rows are dealt by bucket of the
term and by block, so the blocks of a frequent term are spread. Searching joins the items' terms with
their postings, scores every posting once, brings the rows of a block together, and joins there the items
that ask for the term: an item's terms meet in one task, where scores are summed for item and document
without another shuffle. Of each task only the best k of each item go on to the window over the item.

A null or empty text has no terms, is in no result and counts in no statistic. Rows are documents of their
own, also where a key repeats or is null; ties go by ascending key, null first, and then by row. Items of the
same id are one item with the terms of all of them; an item without terms has no rows. Very long texts are blocks of
their own. Only key and text are read, so other columns' names can't clash. Empty tables give an empty result.
"""

from collections import Counter
from math import inf

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgrid.llm.common import chunks, drop, written

#: Bytes of text in a block of the index.
BLOCK_BYTES = 8 << 20
BUCKETS = 256
#: The items' terms are sent to the tasks if they are no more bytes and rows than this; beyond, tables are joined by shuffles.
SENT_BYTES, SENT_ROWS = 8 << 20, 500_000

#: By byte: letters and digits as they count, a space for what is between terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list:
    return text.translate(TERM_BYTES).split()


def _blocks(kind: pa.DataType, wanted):
    """Posting rows of each block; one more, of the empty term, has in tfs the documents with terms, in sizes all terms of the block."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in chunks(batch, 1, BLOCK_BYTES):
                found: dict = {}
                sizes = np.zeros(rows.num_rows, np.int64)
                for i, text in enumerate(rows.column(1).cast(pa.binary()).to_pylist()):
                    terms = terms_of(text) if text else ()
                    sizes[i] = len(terms)
                    for term, n in Counter(terms if wanted is None else [t for t in terms if t in wanted]).items():
                        found.setdefault(term, []).append((i, n))
                counts = np.array([len(x) for x in found.values()] + [1], np.int64)
                flat = np.array([x for of in found.values() for x in of] or np.empty((0, 2)), np.int64).reshape(-1, 2)
                places = np.append(flat[:, 0], 0)
                lists = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                has = int((sizes > 0).sum())
                columns = {
                    "block": pa.array(np.full(len(counts), part << 32 | number), pa.int64()),
                    "term": pa.array([*found, b""], pa.binary()).cast(pa.string()),
                    "rows": pa.ListArray.from_arrays(lists, pa.array(places, pa.int32())),
                    "keys": pa.ListArray.from_arrays(lists, rows.column(0).take(pa.array(places)).cast(kind)),
                    "tfs": pa.ListArray.from_arrays(lists, pa.array(np.append(flat[:, 1], has), pa.int64())),
                    "sizes": pa.ListArray.from_arrays(lists, pa.array(np.append(sizes[flat[:, 0]], sizes.sum()), pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns)
                number += 1

    return run


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, wanted: frozenset | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, term, block, rows, keys, tfs, sizes): see ``_blocks``. wanted: the only terms that count, as UTF-8; None: all."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    name = kind.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_blocks(to_arrow_type(kind), wanted), f"block long, term string, rows array<int>, keys array<{name}>, tfs array<long>, sizes array<long>")
    return rows.select(bucket(F.col("term")).alias("bucket"), "term", "block", "rows", "keys", "tfs", "sizes").repartition("bucket", "block").sortWithinPartitions("bucket", "term")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, bucket, term), each once."""

    def run(batches):
        for batch in batches:
            terms = [sorted(set(terms_of(x or b""))) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"item {kind}, terms array<string>")
    return rows.select("item", F.explode("terms").alias("term")).distinct().select("item", bucket(F.col("term")).alias("bucket"), "term")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", sent_bytes: float = SENT_BYTES, sent_rows: float = SENT_ROWS) -> DataFrame:
    """Of each item its k best documents with a score above 0: item key, rank from 1, key, score."""
    spark = docs.sparkSession
    asked, asked_path = written(item_terms(items, item_key, text), "item-terms")
    size = asked.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    small = size[0] <= sent_rows and (size[1] or 0) <= sent_bytes
    terms = asked.select("bucket", "term").distinct()
    wanted = frozenset(r.term.encode() for r in terms.collect()) if small else None  # behind the check of its size
    index, index_path = written(postings(docs, wanted, key, text), "postings")
    n_docs, n_terms, n_blocks = index.filter("term = ''").agg(F.sum(F.element_at("tfs", 1)), F.sum(F.element_at("sizes", 1)), F.count("*")).first()

    sent = F.broadcast if small else lambda df: df
    df = index.filter("term <> ''").groupBy("bucket", "term").agg(F.sum(F.size("rows")).alias("df"))
    weights = terms.join(df, ["bucket", "term"]).select("bucket", "term", F.floor(1000 * F.log((2 * F.lit(n_docs or 0) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    m = f"(50 + (50 * n * {n_docs or 0}L) div {max(n_terms or 0, 1)}L)"
    scores = F.expr(f"transform(arrays_zip(tfs, sizes), x -> w * ((1000000000 * x.tfs) div (1000 * x.tfs + 20 * {m.replace('n *', 'x.sizes *')})))")
    scored = index.join(sent(weights), ["bucket", "term"]).select("block", "bucket", "term", F.arrays_zip("rows", "keys", scores.alias("scores")).alias("found"))
    n = max(1, min(n_blocks or 1, 100_000))
    if small:
        matches = scored.repartition(n, "block").join(F.broadcast(asked), ["bucket", "term"])
    else:
        matches = scored.join(asked, ["bucket", "term"]).repartition(n, "block")
    each = matches.select("block", "item", F.explode("found").alias("d")).select("block", "item", F.col("d.rows").alias("row"), F.col("d.keys").alias("key"), F.col("d.scores").alias("s"))
    summed = each.groupBy("block", "item", "row", "key").agg(F.sum("s").alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"), "block", "row")
    ranked = summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= (k if k < inf else 2**31 - 1))
    out, _ = written(ranked.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score"), "found")
    drop(spark, asked_path, index_path)
    return out
