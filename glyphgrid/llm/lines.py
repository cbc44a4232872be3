"""Line dedup by pairwise alignment of overlapping documents.

1. A line here is a run of ``SEED_WORDS`` words that the text itself chooses, so that it doesn't
   matter where line breaks fall: each window of ``BLOCK_WORDS`` words gives the least hash of its
   runs (winnowing), so documents that share a window share the hash of a line in it.
2. Of equal texts the first stands for all; the others lose every word, if they have
   ``BLOCK_WORDS`` at all. What follows is about distinct texts.
3. A line with ``RARE`` holders at most pairs each of them with every earlier one. The lines of
   frequent passages would make pairs without end: there each window of ``BLOCK_WORDS``
   words around such a line pairs its holders with the window's first holder, which finds the same windows.
4. A pair is aligned by patience diff over windows: those that are unique in both are anchors, and
   the longest increasing chain of them is the alignment. Common windows that it leaves out
   are passages that stand in another order or are repeated; they are aligned with their place in the earlier text.
5. The aligned blocks, ``BLOCK_WORDS`` words or more, are deleted from the later document, and lines
   (here those of the text) that lose all their words with them. White space between words doesn't count.

Documents are ordered by key (null first), those of equal key by a hash of the text. Rows equal in
both are one document: they keep or lose the same. Null and empty texts stay as they are. A document may lose
all its lines; its row stays, with an empty text. Lines that lose only some words stay and
don't count as deleted. Work on a pair grows with its words, however long or repetitive they are.
Other columns, whatever their names, are carried along. An empty table gives no rows.

Joins whose two sides grow with the documents are sort-merge joins at every size, by a hint, so that what is
shuffled stays in proportion; Spark still splits keys of very many rows.
"""

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphgrid.llm import shingles
from glyphgrid.llm.common import drop, maybe_in, written
from glyphgrid.llm.shingles import hashed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK_WORDS, SEED_WORDS = 30, 12
#: Holders of a line up to which all of them are paired; partners of an earlier document in one task.
RARE, TEAM = 4, 64


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words."""
    return shingles.windows(hashes, size).view(np.int64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def winnowed(hashes: np.ndarray, least: int) -> np.ndarray:
    """The distinct least hashes of runs, one of each window of least words."""
    size = min(SEED_WORDS, least)
    if len(hashes) < least:
        return np.zeros(0, np.int64)
    found = least_of(windows(hashes, size), least - size + 1)
    return np.unique(found[np.concatenate([[True], found[1:] != found[:-1]])])


def windows_near(hashes: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """The distinct hashes of the windows of least words that contain a shared run."""
    size = min(SEED_WORDS, least)
    if len(hashes) < least:
        return np.zeros(0, np.int64)
    hit = np.concatenate([[0], np.cumsum(np.isin(windows(hashes, size), shared))])
    width = least - size + 1
    return np.unique(windows(hashes, least)[hit[width:] > hit[:-width]])


def increasing(pairs: list) -> list:
    """The longest chain that rises in both places; pairs stand by the first."""
    tails, at, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        before[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Early:
    """The windows of an earlier document: sorted hashes, whether each is unique, and its first place."""

    def __init__(self, hashes: np.ndarray, least: int):
        self.hashes, places, counts = np.unique(windows(hashes, least), return_index=True, return_counts=True)
        self.places, self.alone = places, counts == 1


def common_blocks(early: Early, late: np.ndarray, least: int) -> list:
    """Ascending starts and ends, one after the other, of the words of late in blocks that it shares with early."""
    own = windows(late, least)
    if not len(own) or not len(early.hashes):
        return []
    spot = np.minimum(np.searchsorted(early.hashes, own), len(early.hashes) - 1)
    hits = np.flatnonzero(early.hashes[spot] == own)
    if not len(hits):
        return []
    places, alone = early.places[spot[hits]], early.alone[spot[hits]]
    counts = np.unique(own[hits], return_inverse=True, return_counts=True)
    anchor = alone & (counts[2][counts[1]] == 1)
    a, b = hits[anchor], places[anchor]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])[: len(a)])
    ends = [*starts[1:].tolist(), len(a)]
    runs = {int(a[s]): int(a[e - 1]) + least for s, e in zip(starts.tolist(), ends)}
    chain = increasing([(int(a[s]), int(b[s])) for s in starts.tolist()])
    steps = np.zeros(len(late) + 1, np.int64)
    for i, _ in chain:
        steps[i] += 1
        steps[runs[i]] -= 1
    aligned = np.cumsum(steps[:-1]) > 0
    # What the chain leaves out is moved or repeated: window by window it stands at its place in early.
    inside = np.concatenate([[0], np.cumsum(aligned)])
    moved = hits[inside[hits + least] - inside[hits] < least]
    np.add.at(steps, moved, 1)
    np.add.at(steps, moved + least, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).view(np.int8), [0]])))
    return edges.tolist()


def cut(text: str, gone: list) -> tuple:
    """The text less the words in the ranges, and the number of lines that lost all their words."""
    dead: set = set()
    for k in range(0, len(gone), 2):
        dead.update(range(gone[k], gone[k + 1]))
    out, at, deleted = [], 0, 0
    for line in text.split("\n"):
        found = [(m.start(), m.end()) for m in WORD.finditer(line)]
        left = [k for k in range(len(found)) if at + k not in dead]
        at += len(found)
        if found and not left:
            deleted += 1
            continue
        if len(left) < len(found):
            # A kept word takes the space after it along, except where the rest of the line goes.
            parts = [line[: found[0][0]]]
            for k in left:
                parts.append(line[found[k][0] : found[k + 1][0] if k + 1 < len(found) and k != left[-1] else found[k][1]])
            if left[-1] == len(found) - 1:
                parts.append(line[found[-1][1] :])
            line = "".join(parts)
        out.append(line)
    return "\n".join(out), deleted


def _lists(rows: list, kind) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def seeded(texts: DataFrame, least: int) -> DataFrame:
    """texts (id, th, th2, text) to (id, th, th2, n, seeds): words and line hashes of those with least words."""

    def run(batches):
        for batch in batches:
            n, found = [], []
            for value in batch.column(3):
                hashes = hashed_words(value.as_py() or b"")
                n.append(len(hashes))
                found.append(winnowed(hashes, least))
            keep = pa.array([k >= least for k in n])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int32()), _lists(found, pa.int64())], names=["id", "th", "th2", "n", "seeds"]).filter(keep)

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, th long, th2 long, n int, seeds array<long>")


def overlapping(texts: DataFrame, held: DataFrame, ids: DataFrame, least: int) -> tuple[DataFrame, str]:
    """held (row, seeds) of the distinct texts ids (row, rid, id, th) to the pairs (late, early) of rids to align."""
    spark = texts.sparkSession
    lines = held.select("row", F.explode("seeds").alias("seed"))
    counts, counts_path = written(lines.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"), "line-counts")
    shared, shared_path = written(maybe_in(lines, [F.col("seed")], counts, [F.col("seed")]).join(counts.hint("merge"), "seed").join(ids.select("row", "rid").hint("merge"), "row").select("rid", "seed", "n"), "shared-lines")
    rare = shared.filter(F.col("n") <= RARE).groupBy("seed").agg(F.array_sort(F.collect_set("rid")).alias("r"))
    later = F.flatten(F.transform("r", lambda y, k: F.transform(F.slice("r", F.lit(1), k), lambda x: F.struct(y.alias("late"), x.alias("early")))))
    pairs = rare.filter(F.size("r") > 1).select(F.explode(later).alias("p")).select("p.*")
    often = shared.filter(F.col("n") > RARE).groupBy("rid").agg(F.collect_list("seed").alias("seeds"))

    def around(batches):
        for batch in batches:
            found = [windows_near(hashed_words(t.as_py() or b""), np.asarray(s, np.int64), least) for t, s in zip(batch.column(2), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, pa.int64())], names=["rid", "windows"])

    often, often_path = written(often.join(ids.select("rid", "id", "th").hint("merge"), "rid"), "often")
    near, near_path = written(with_texts(texts, often, "rid", "seeds").mapInArrow(around, "rid long, windows array<long>"), "windows")
    rows = near.select("rid", F.explode("windows").alias("window"))
    first, first_path = written(rows.groupBy("window").agg(F.min("rid").alias("early"), F.count("*").alias("n")).filter("n > 1").select("window", "early"), "first-holders")
    more = maybe_in(rows, [F.col("window")], first, [F.col("window")]).join(first.hint("merge"), "window").filter("rid <> early").select(F.col("rid").alias("late"), "early")
    out, path = written(pairs.unionByName(more).distinct(), "line-pairs")
    drop(spark, counts_path, shared_path, often_path, near_path, first_path)
    return out, path


def with_texts(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of rows (which have id and th) and the text."""
    some = maybe_in(texts.select("id", "th", "text"), [F.col("id"), F.col("th")], rows, [F.col("id"), F.col("th")])
    return rows.alias("r").hint("merge").join(some.alias("t"), F.col("r.id").eqNullSafe(F.col("t.id")) & (F.col("r.th") == F.col("t.th"))).select(*columns, "text")


def aligned(texts: DataFrame, pairs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(rid, gone) of each pair: the ranges of words that the later text loses. An earlier document of many
    partners works in teams, each with a copy of its text."""
    teams = F.ceil(F.count("*") / TEAM).cast("int")
    pairs = pairs.join(pairs.groupBy("early").agg(teams.alias("teams")).hint("merge"), "early").withColumn("team", F.pmod(F.xxhash64("late"), F.col("teams")).cast("int"))
    parts = pairs.select(F.col("late").alias("rid"), "early", "team").unionByName(pairs.select(F.col("early").alias("rid"), "early", "team").distinct())
    parts, _ = written(parts.join(ids.select("rid", "id", "th").hint("merge"), "rid"), "line-parts")

    def run(batches):
        key, early, last = None, None, None
        for batch in batches:
            rids, gone = [], []
            for e, team, rid, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if (e, team) != key:
                    key, early, last = (e, team), None, None
                if rid == last:  # a row equal in key and text
                    continue
                last = rid
                hashes = hashed_words(text.as_py() or b"")
                if rid == e:
                    early = Early(hashes, least)
                    continue
                got = common_blocks(early, hashes, least)
                if got:
                    rids.append(rid)
                    gone.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), _lists(gone, pa.int32())], names=["rid", "gone"])

    # The earlier document has the least number of its team, so it comes first.
    rows = with_texts(texts, parts, "early", "team", "rid").repartition("early", "team").sortWithinPartitions("early", "team", "rid")
    return rows.mapInArrow(run, "rid long, gone array<int>")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS, counts: bool = True) -> DataFrame:
    """The rows and columns of docs, common blocks deleted, and _n_lines and _n_deleted if counts."""
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.struct(*columns).alias("row"))
    whole = whole.withColumn("th", F.xxhash64("t"))
    texts = whole.select("id", "th", F.xxhash64(F.lit(1), "t").alias("th2"), F.col("t").cast("binary").alias("text"))
    all_lines, all_path = written(seeded(texts, least).withColumn("row", F.monotonically_increasing_id()), "lines")
    heads = all_lines.select("row", "id", "th", "th2", "n")
    # Equal texts: the first by key stands for all.
    firsts = heads.groupBy("th", "th2").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("f"), F.count("*").alias("copies"))
    firsts, firsts_path = written(firsts.select("th", "th2", "f.id", "f.row", "copies"), "line-firsts")
    ids, ids_path = written(firsts.select("row", "id", "th").repartitionByRange("id", "th").sortWithinPartitions("id", "th").withColumn("rid", F.monotonically_increasing_id()), "line-docs")
    others = firsts.filter("copies > 1").select("th", "th2", F.col("id").alias("first_id"), F.col("row").alias("first_row"))
    copies, copies_path = written(heads.join(others.hint("merge"), ["th", "th2"]).filter("row <> first_row").select("row", "id", "th", "n", F.col("id").eqNullSafe(F.col("first_id")).alias("same")), "copies")
    whole_gone = copies.filter("not same").select("id", "th", F.array(F.lit(0), F.col("n")).alias("gone")).distinct()
    # The lines of copies are left out; only rows that may be copies are shuffled for it.
    lines = all_lines.select("row", "seeds")
    held = maybe_in(lines, [F.col("row")], copies, [F.col("row")], inside=False).unionByName(maybe_in(lines, [F.col("row")], copies, [F.col("row")]).join(copies.select("row").hint("merge"), "row", "left_anti"))
    pairs, pairs_path = overlapping(texts, held, ids, least)
    found = aligned(texts, pairs, ids, least).groupBy("rid").agg(F.flatten(F.collect_list("gone")).alias("gone")).join(ids.hint("merge"), "rid").select("id", "th", "gone")
    gone, _ = written(found.unionByName(whole_gone), "gone")
    drop(spark, pairs_path, all_path, ids_path, firsts_path, copies_path)

    def cleaned(batches):
        for batch in batches:
            got, n_lines = [], []
            for value, ranges in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                got.append(cut(value, ranges) if ranges else (value, 0))
                n_lines.append(sum(WORD.search(line) is not None for line in (value or "").split("\n")))
            out = pa.array([t for t, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], out, *batch.columns[at + 1 : -1], pa.array(n_lines, pa.int32()), pa.array([n for _, n in got], pa.int32())], names=names)

    at = docs.columns.index(text)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "n_lines", "n_deleted"]
    both = [F.col("id"), F.col("th")]
    # Only rows that may lose something are shuffled.
    touched = maybe_in(whole, both, gone, both).alias("w").join(gone.alias("g").hint("merge"), F.col("w.id").eqNullSafe(F.col("g.id")) & (F.col("w.th") == F.col("g.th")), "left").select("t", "row", "gone")
    rest = maybe_in(whole, both, gone, both, inside=False).select("t", "row", F.lit(None).cast("array<int>").alias("gone"))
    rows = touched.unionByName(rest)
    rows = rows.select(*[(F.col("t") if c == text else F.col("row").getField(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)], "gone")
    schema = ", ".join(f"c{i} {'string' if f.name == text else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = rows.mapInArrow(cleaned, schema + ", n_lines int, n_deleted int")
    added = [F.col("n_lines").alias("_n_lines"), F.col("n_deleted").alias("_n_deleted")] if counts else []
    return out.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)], *added)


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_deleted").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
