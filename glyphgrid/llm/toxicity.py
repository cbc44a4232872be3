"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits and of all other characters above ASCII, with A-Z in lower case. The features
of a text are its single words, its pairs of neighbours, and the pairs with one and with two words between, each hashed
to ``BITS`` bits and counted once. Every coordinate has a learning rate of its own, and an L1 penalty leaves most weights
at zero, so the model is a short sorted list of hashes and weights, which is sent to the tasks that score.

It is fitted on a bounded sample: of the labelled rows that may be learnt from at most ``MAX_DOCS`` documents, those of
least hash, and of these, in the same order, as many as have ``MAX_FEATURES`` features together. One task fits them.
Scoring covers the whole of every text. Neither labels nor languages, sources or keys are inputs of a score.

Null and empty texts get the score of a text without features. Rows that repeat are scored alike; where a labelled key
has several texts, the one of least hash is learnt from, and a key with different labels counts as toxic. Null keys are never
learnt from. Without any label every score is 0. Very long texts are hashed by blocks of bytes. Only the named columns are
read, so the names of others can't clash. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgrid.llm.common import chunks, drop, written
from glyphgrid.llm.search import TERM_BYTES

BITS = 31
MAX_DOCS, MAX_FEATURES = 20_000, 10_000_000
#: Of FTRL-proximal: the rate's numerator and its shift, the two penalties, and how often the sample is gone through.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 1.0, 6
THRESHOLD = 0.3
#: Words between the two of a pair, and none for single words.
GAPS = (None, 0, 1, 2)
CHUNK_BYTES, BLOCK_BYTES = 4 << 20, 1 << 20

_IS_WORD = np.frombuffer(TERM_BYTES, np.uint8) != 32
_FOLDED = np.frombuffer(TERM_BYTES, np.uint8).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """The hash of each word of the texts in data, and the text that it is in."""
    hashes, texts = [], []
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK_BYTES)
        while to < len(data) and _IS_WORD[data[to]] and _IS_WORD[data[to - 1]] and not begins[to]:  # not inside a word
            to += 1
        inside = _IS_WORD[data[at:to]]
        first = inside & (begins[at:to] | np.concatenate([[True], ~inside[:-1]]))
        starts = np.flatnonzero(first)
        if len(starts):
            places = np.flatnonzero(inside)
            word = np.cumsum(first)[places] - 1
            terms = _FOLDED[data[at:to][places]] * _POWERS[(places - starts[word]) & 0xFFFF]
            hashes.append(_mixed(np.add.reduceat(terms, np.searchsorted(places, starts))))
            texts.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = to
    return (np.concatenate(hashes), np.concatenate(texts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def features(data: np.ndarray, offsets: np.ndarray):
    """For each kind of feature the text and the hash of each occurrence."""
    words, texts = word_hashes(data, offsets)
    for kind, gap in enumerate(GAPS):
        if gap is None:
            h, of = words, texts
        else:
            same = texts[gap + 1 :] == texts[: len(texts) - gap - 1]
            h, of = (words[: len(words) - gap - 1] * _ODD + words[gap + 1 :])[same], texts[gap + 1 :][same]
        yield of, (_mixed(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def _buffers(column) -> tuple:
    """The bytes and offsets of a text column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def with_features(docs: DataFrame, kept: list, text: str) -> DataFrame:
    """The kept columns and the distinct features of each text."""

    def run(batches):
        for batch in batches:
            for rows in chunks(batch, batch.num_columns - 1, CHUNK_BYTES):
                pairs = [of << BITS | h for of, h in features(*_buffers(rows.column(rows.num_columns - 1)))]
                pairs = np.unique(np.concatenate(pairs))
                offsets = np.searchsorted(pairs >> BITS, np.arange(rows.num_rows + 1))
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs & (1 << BITS) - 1, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names=[*kept, "features"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, features array<int>")


def ftrl(offsets: np.ndarray, flat: np.ndarray, labels: np.ndarray, order: np.ndarray | None = None, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple:
    """(hashes, weights, bias): the weights that aren't zero, by ascending hash. The bias has no penalty. order: of the documents.

    While a weight is zero, its z moves by less than 1 for each document and epoch; features of too few documents to get
    past the penalty stay at zero, and are left out before.
    """
    names, counts = np.unique(flat, return_counts=True)
    names = names[counts * epochs > l1]
    at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    kept = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    local = at[kept].astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bias_z = bias_n = 0.0

    def weights(at):
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias = 0.0
    for _ in range(epochs):
        for i in range(len(labels)) if order is None else order.tolist():
            y, at = labels[i], local[offsets[i] : offsets[i + 1]]
            w = weights(at)
            bias = -bias_z * alpha / (beta + np.sqrt(bias_n))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y  # the gradient, alike for all features of value 1
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = weights(slice(None))
    return names[w != 0], w[w != 0], -bias_z * alpha / (beta + np.sqrt(bias_n))


def sample(docs: DataFrame, labels: DataFrame, learnable: Column, key: str, text: str, label: str, max_docs: int, max_features: int) -> DataFrame:
    """(order, label, features): the documents that are learnt from; see above for the bounds."""
    known = labels.filter(learnable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.withColumn("order", F.xxhash64(F.col("key").cast("string"))).orderBy("order", "key").limit(max_docs)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "key")  # max_docs rows of three numbers at most
    once = rows.groupBy("key", "label", "order").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("order", "key", "label", F.col("t.text").alias("text"))
    found, path = written(with_features(once, ["order", "key", "label"], "text"), "features")
    # Two numbers for each of at most max_docs rows.
    before = found.select("order", "key", F.size("features").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)))
    chosen = found.join(F.broadcast(before.filter(F.col("upto") <= max_features).select("order", "key")), ["order", "key"]).select("order", "label", "features")
    out, _ = written(chosen, "sample")
    drop(docs.sparkSession, path)
    return out


def fit(chosen: DataFrame) -> tuple:
    """(hashes, weights, bias) of a bounded sample; None without one."""

    def run(table):
        labels = table.column("label").to_numpy().astype(np.float64)
        order = np.lexsort((labels, table.column("order").to_numpy()))
        lists = table.column("features").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        h, w, bias = ftrl(offsets - offsets[0], lists.flatten().to_numpy(), labels, order)
        return pa.table({"feature": pa.array(np.append(h, -1), pa.int64()), "weight": pa.array(np.append(w, bias), pa.float64())})

    # The one place where rows meet in a task: the sample, which has a bound.
    model = chosen.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "feature long, weight double").orderBy("feature").toArrow()
    if not model.num_rows:
        return None
    h, w = model.column("feature").to_numpy(), model.column("weight").to_numpy()
    return h[1:].astype(np.int64), w[1:], float(w[0])


def logits(data: np.ndarray, offsets: np.ndarray, model: tuple) -> np.ndarray:
    hashes, weights, bias = model
    out = np.full(len(offsets) - 1, bias)
    if not len(hashes):
        return out
    marks = np.zeros(1 << 20, bool)
    marks[hashes & 0xFFFFF] = True
    hits = []
    for of, h in features(data, offsets):
        may = marks[h & 0xFFFFF]
        of, h = of[may], h[may]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        right = hashes[at] == h
        hits.append(of[right] * len(hashes) + at[right])
    hits = np.unique(np.concatenate(hits))  # a feature counts once in a text
    return out + np.bincount(hits // len(hashes), weights[hits % len(hashes)], minlength=len(out))


def score(docs: DataFrame, model: tuple | None, keep: tuple = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as long as the weights that a bounded sample has

    def run(batches):
        own = sent.value
        for batch in batches:
            for rows in chunks(batch, len(keep), CHUNK_BYTES):
                p = np.zeros(rows.num_rows) if own is None else 1 / (1 + np.exp(-np.clip(logits(*_buffers(rows.column(len(keep))), own), -35, 35)))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, score double, predicted int")


def held_out(key: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES) -> DataFrame:
    """Of each row: key, held_out, score and predicted."""
    model = fit(sample(docs, labels, ~held_out(F.col(key)), key, text, label, max_docs, max_features))
    return score(docs, model, (key,), text).select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted")
