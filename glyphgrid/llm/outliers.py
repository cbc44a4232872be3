"""Quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

1. Counts of each whole text give a failed base rule or a vector of five transformed
   statistics. Four are shares, on ``LEVELS`` levels each; the mean word length stands on six
   levels for each doubling, without an upper end.
2. The documents of each language and source are counted by grid cell. A group has at most
   ``LEVELS ** 4`` cells for each level of the word length however many documents it has, so one
   task fits it: C-steps keep the ``SUPPORT`` share of documents nearest to the centre until a
   choice returns; of two
   deterministic starts the estimate of smaller determinant counts. A group's estimate leans on its
   language's, as if that were ``LEAN`` documents more, and a language's on that of all.
3. A document is rejected where its squared Mahalanobis distance exceeds the chi-square
   quantile of ``1 - TAIL``. One squared level is added to every variance, so that a group of
   equal documents doesn't reject the next best one.

Null and empty texts have no words and fail the base rule. Null languages and sources are
groups of their own. Repeated rows count as often as they occur. An empty table gives no rows.
"""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphgrid.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "[#*$%&|<>]"
#: Fixed value: the symbols of the base counts.
SYMBOL = re.compile(SYMBOLS)
UPPER, OTHER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
DIMS, LEVELS = 5, 24
SUPPORT, LEAN, TAIL = 0.75, 100, 1e-6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def counts(text: str) -> tuple:
    words = WORD.findall(text)
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeat_words(words)


def cell(text: str, got: tuple) -> int:
    """The grid cell of a text, as one number; the counts are those of the text."""
    n, chars, symbols, dup, repeated = got
    if not n:
        return 0
    other = len(OTHER.findall(text)) - (len(text) - chars)
    upper = sum(1 for c in text if c.isupper())
    shares = (symbols / chars, other / chars, upper / chars)
    again = max(repeated / n, dup / (1 + text.count("\n")))
    levels = [6 * math.log2(max(chars / n, 1.0))] + [(LEVELS - 1) * math.sqrt(min(max(s, 0.0), 1.0)) for s in shares] + [(LEVELS - 1) * again]
    out = int(levels[0])
    for level in levels[1:]:
        out = out * LEVELS + min(int(level), LEVELS - 1)
    return out


def statistics(docs: DataFrame, keep: tuple = (), text: str = "text") -> DataFrame:
    """The kept columns, lang and source as _lang and _source, the counts and the cell of each row."""

    def run(batches):
        for batch in batches:
            got, cells = [], []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py() or ""
                got.append(counts(value))
                cells.append(cell(value, got[-1]))
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, pa.array(cells, pa.int32())], names=[*names, *(f"_{c}" for c in COUNTS), "_cell"])

    part = docs.select(*[F.col(f"`{c}`") for c in keep], _key("lang").alias("_lang"), _key("source").alias("_source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    names = part.columns[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]] + [f"_{c} long" for c in COUNTS] + ["_cell int"])
    return part.mapInArrow(run, schema)


def _key(name: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit("n"))


def chi_square_cdf(x: float, dof: int) -> float:
    a, z = dof / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi_square_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dof) < q else (low, middle)
    return high


def points(cells) -> np.ndarray:
    cells = np.asarray(cells, np.int64)
    return np.stack([cells // LEVELS ** (DIMS - 1)] + [cells // LEVELS**k % LEVELS for k in range(DIMS - 2, -1, -1)], 1).astype(float)


def mcd(x: np.ndarray, weight: np.ndarray, support: float = SUPPORT) -> tuple:
    """Centre and covariance of weighted points, by C-steps from two starts."""
    total = weight.sum()
    need = math.ceil(support * total)
    ridge = np.eye(x.shape[1])
    scale = support / chi_square_cdf(chi_square_quantile(support, x.shape[1]), x.shape[1] + 2)

    def moments(w):
        centre = w @ x / w.sum()
        off = x - centre
        return centre, (off * w[:, None]).T @ off / w.sum()

    def median(values):
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(weight[order]), total / 2)]

    middle = np.array([median(column) for column in x.T])
    spread = np.array([median(np.abs(column - m)) for column, m in zip(x.T, middle)]) * 1.4826
    best = None
    for centre, cov in ((middle, np.diag(spread**2)), moments(weight.astype(float))):
        seen: set = set()
        while True:
            off = x - centre
            distance = np.einsum("ij,ij->i", off @ np.linalg.inv(cov + ridge), off)
            order = np.lexsort((*x.T, np.round(distance, 9)))
            sums = np.cumsum(weight[order])
            used = np.zeros(len(x))
            used[order] = np.clip(need - (sums - weight[order]), 0, weight[order])
            centre, cov = moments(used)
            mark = hashlib.blake2b(used.tobytes(), digest_size=16).digest()
            if mark in seen:
                break
            seen.add(mark)
        size = np.linalg.slogdet(cov + ridge)[1]
        if best is None or size < best[0] - 1e-9:
            best = size, centre, cov
    return best[1], best[2] * scale + ridge


def estimates(cells: DataFrame, lean: int = LEAN) -> DataFrame:
    """cells (_lang, _source, _cell, n) to a row for each group: the centre and the inverse covariance that judge it."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        weight = group["n"].to_numpy(np.int64)
        centre, cov = mcd(points(group["_cell"]), weight)
        return pd.DataFrame({"_lang": group["_lang"][:1], "_source": group["_source"][:1], "docs": [int(weight.sum())], "centre": [centre.tolist()], "cov": [cov.ravel().tolist()]})

    def blend(frames):
        for rows in frames:
            out = []
            for lang, source, *parts in zip(*[rows[c] for c in rows.columns]):
                centre, cov = np.array(top.centre), np.array(top.cov)
                for docs, own_centre, own_cov in (parts[:3], parts[3:]):
                    share = docs / (docs + lean)
                    centre, cov = share * np.array(own_centre) + (1 - share) * centre, share * np.array(own_cov) + (1 - share) * cov
                out.append((lang, source, centre.tolist(), np.linalg.inv(cov.reshape(DIMS, DIMS)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["_lang", "_source", "centre", "inverse"])

    every = F.lit("*")
    by_lang = cells.groupBy("_lang", every.alias("_source"), "_cell").agg(F.sum("n").alias("n"))
    by_all = cells.groupBy(every.alias("_lang"), every.alias("_source"), "_cell").agg(F.sum("n").alias("n"))
    rows = cells.select("_lang", "_source", "_cell", "n").unionByName(by_lang).unionByName(by_all)
    fits, _ = written(rows.groupBy("_lang", "_source").applyInPandas(fit, "_lang string, _source string, docs long, centre array<double>, cov array<double>"), "mcd")
    own, lang, whole = fits.filter("_source <> '*'"), fits.filter("_source = '*' and _lang <> '*'"), fits.filter("_lang = '*'")
    top = whole.first()  # one row, or none of an empty table
    joined = own.alias("o").join(lang.alias("l"), F.col("o._lang") == F.col("l._lang"))
    fields = [F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "lo" for c in ("docs", "centre", "cov")]
    return joined.select("o._lang", "o._source", *fields).mapInPandas(blend, "_lang string, _source string, centre array<double>, inverse array<double>")


def judge(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text", lean: int = LEAN, tail: float = TAIL) -> DataFrame:
    """The kept columns and _n_words and the other counts, _base_failed, _distance (squared) and _kept of each row."""
    failed = (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))
    rows, _ = written(statistics(docs, keep, text).withColumn("_base_failed", failed), "quality")
    cells = rows.filter("not _base_failed").groupBy("_lang", "_source", "_cell").agg(F.count("*").alias("n"))
    fits, _ = written(estimates(written(cells, "cells")[0], lean), "fits")
    digit = [F.floor(F.col("_cell") / LEVELS**k) for k in range(DIMS - 1, -1, -1)]
    level = [(d % LEVELS if i else d) - F.col("centre")[i] for i, d in enumerate(digit)]
    distance = sum((level[i] * level[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))
    judged = rows.join(fits, ["_lang", "_source"], "left").withColumn("_distance", F.when(~F.col("_base_failed"), distance))
    kept = ~F.col("_base_failed") & F.coalesce(F.round("_distance", 6) <= chi_square_quantile(1 - tail, DIMS), F.lit(False))
    return judged.withColumn("_kept", kept).select(*[F.col(f"`{c}`") for c in keep], *[f"_{c}" for c in COUNTS], "_base_failed", "_distance", "_kept")


def verdicts(docs: DataFrame) -> DataFrame:
    names = (*COUNTS, "base_failed", "kept", "distance")
    return judge(docs).select("doc_id", *[F.col(f"_{c}").alias(c) for c in names])
