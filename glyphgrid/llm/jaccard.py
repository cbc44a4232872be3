"""N-gram Jaccard join with a count-vector R-tree.

1. A document becomes its set of hashed shingles. Equal sets are one node from here on.
2. Shingles are hashed into ``GROUPS`` groups; how many of a set fall into each is a point. The
   sum of coordinate minima of two points bounds the intersection of the sets from above.
3. Two linked sets share a shingle among the first ``n - ceil(t n) + 1`` of each in any fixed
   order of shingles. The order is by load of the shingle's bucket, so that shingles of
   frequent passages come last. The nodes of one such shingle are a block; of blocks
   with the same nodes one is kept.
4. The points of a block stand in an R-tree: leaves of ``LEAF`` points, split by the coordinate
   that varies most, under boxes of largest coordinates, level by level. A search goes down
   only where the sum of minima with the box reaches the least intersection that links.
5. Turns. First each node proposes one partner: a block's most central node, or else its nearest
   by the bound. Then nodes outside a block's largest component propose their nearest in
   another one. Last, all pairs of different components that the bound lets through are taken. After each
   turn the pairs are verified on the shingle sets, and components come by alternating stars;
   blocks of one component are done with, as they can add nothing.

A block over ``CHUNK`` nodes is split into chunks, and each pair of chunks is searched in a task
of its own: no task holds more than two chunks, and no pair is lost. Null texts and texts
without words have no shingles and link with nothing, equal ones included.
Repeated rows are members of one node; rows of equal key keep a row each. Very long texts are
sets like others. Other columns of the input aren't read. An empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from glyphgrid.llm import graph
from glyphgrid.llm.common import drop, maybe_in, written
from glyphgrid.llm.shingles import shingle_set

WORDS, PERCENT = 4, 85
GROUPS, BUCKETS, CHUNK, LEAF = 256, 1 << 16, 4096, 16
TURNS = ("central", "nearest", "all")
_EDGES = "a long, b long, margin double"


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def point(shingles: np.ndarray) -> bytes:
    """Group counts in one byte each, or in four where one is over 255."""
    counts = np.bincount((shingles >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def coordinates(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if len(packed) == GROUPS else np.uint32).astype(np.int32)


def needed(n, m, percent: int):
    """The least intersection at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def counted(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, th, n, node) of each row, th being its text's hash, and beside them rows (bucket, load): how many shingles fall into each bucket."""

    def run(batches):
        loads = np.zeros(BUCKETS, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            sizes, nodes = [], []
            for value in batch.column(2):
                s = shingle_set(value.as_py() or b"", words)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                loads += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), none, none], names=names)
        if kind is not None:
            used = np.flatnonzero(loads)
            none = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, kind), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), pa.array(used), pa.array(loads[used])], names=names)

    names = ["id", "th", "n", "node", "bucket", "load"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").cast("binary")).mapInArrow(run, f"id {kind}, th long, n long, node binary, bucket long, load long")


def bucket_ranks(rows: DataFrame) -> np.ndarray:
    """The place of each bucket by its load in the whole input."""
    loads = np.zeros(BUCKETS, np.int64)
    for row in rows.filter("bucket is not null").groupBy("bucket").agg(F.sum("load").alias("load")).collect():  # BUCKETS rows at most
        loads[row.bucket] = row.load
    ranks = np.zeros(BUCKETS, np.uint64)
    ranks[np.lexsort((np.arange(BUCKETS), loads))] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def distinct_sets(docs: DataFrame, text: str, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(nid, node, n, point, prefix) of each distinct set; prefix holds the shingles that stand first in the order."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    low = np.uint64((1 << 48) - 1)

    def run(batches):
        ranks = held.value
        for batch in batches:
            out = [], [], [], []
            for value in batch.column(0):
                s = shingle_set(value.as_py() or b"", words)
                n = len(s)
                if n:
                    # The bucket's place instead of its number in the leading bits: another name of the same shingle.
                    order = (ranks[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (s & low)
                    k = n - -(-percent * n // 100) + 1
                    out[0].append(node_of(s))
                    out[1].append(n)
                    out[2].append(point(s))
                    out[3].append(np.partition(order, k - 1)[:k].view(np.int64))
            kinds = pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, out, kinds)], names=["node", "n", "point", "prefix"])

    every = docs.select(F.col(text).cast("string").cast("binary")).mapInArrow(run, "node binary, n long, point binary, prefix array<long>")
    first = every.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "point", "prefix")])
    return first.select(F.monotonically_increasing_id().alias("nid"), "node", "n", "point", "prefix")


def shared_blocks(nodes: DataFrame) -> tuple[DataFrame, str]:
    """(token, nid, size): the nodes of each prefix shingle that two or more hold; of equal blocks the one of least token."""
    spark = nodes.sparkSession
    by = Window.partitionBy("token")
    rows = nodes.select("nid", F.explode("prefix").alias("token"))
    sums = [F.bit_xor(F.xxhash64("nid", F.lit(k))).over(by).alias(f"x{k}") for k in (0, 1)]
    rows, path = written(rows.select("token", "nid", F.count("*").over(by).alias("size"), *sums).filter("size > 1"), "shared")
    kept = rows.groupBy("size", "x0", "x1").agg(F.min("token").alias("token")).select("token")
    blocks, end = written(rows.select("token", "nid", "size").join(kept.hint("merge"), "token", "left_semi"), "blocks")
    drop(spark, path)
    return blocks, end


class Tree:
    """An R-tree of points: boxes hold their largest coordinates and least size."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.concatenate(list(self._split(points, np.arange(len(n)))))
        self.points, self.n = points[self.order], n[self.order]
        self.levels = []
        tops, least = self.points, self.n
        while len(least) > LEAF:
            cuts = np.arange(0, len(least), LEAF)
            tops, least = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least))

    def _split(self, points: np.ndarray, part: np.ndarray):
        if len(part) <= LEAF:
            yield part
            return
        own = points[part]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        half = -(-len(part) // (2 * LEAF)) * LEAF
        part = part[np.argsort(own[:, axis], kind="stable")]
        yield from self._split(points, part[:half])
        yield from self._split(points, part[half:])

    def search(self, p: np.ndarray, n: int, percent: int):
        """(places, by how much the bound exceeds the need) of the points that may link with p."""
        least, most = -(-percent * n // 100), n * 100 // percent
        at = None
        for tops, sizes in [*self.levels[::-1], (self.points, self.n)]:
            at = np.arange(len(sizes)) if at is None else (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(sizes)]
            bound = np.minimum(tops[at], p).sum(1)
            over = bound - needed(n, np.maximum(sizes[at], least), percent)
            ok = (over >= 0) & (sizes[at] <= most)
            at, over = at[ok], over[ok]
        ok = self.n[at] >= least
        return self.order[at[ok]], over[ok]


def block_pairs(n: np.ndarray, points: np.ndarray, comps, percent: int, turn: str):
    """(i, j, margin): pairs of a block that the bound lets through, as the turn asks; i proposes."""
    size = len(n)
    if turn == "central":
        hub = int(np.argmin(np.abs(points - points.mean(0)).sum(1))) if size > 2 else 0
        over = np.minimum(points, points[hub]).sum(1) - needed(n, n[hub], percent)
        over[hub] = -1
        for i in np.flatnonzero(over >= 0).tolist():
            yield i, hub, over[i] / n[i]
        asking = np.flatnonzero(over < 0) if size > 2 else []
    else:
        names, which, counts = np.unique(comps, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        # Of two different components one isn't the largest: its nodes ask.
        asking = np.flatnonzero(which != np.argmax(counts))
    if not len(asking):
        return
    tree = Tree(points, n)
    for i in asking:
        j, over = tree.search(points[i], n[i], percent)
        ok = j != i if turn == "central" else comps[j] != comps[i]
        j, over = j[ok], over[ok]
        if not len(j):
            continue
        if turn == "all":
            for k in j.tolist():
                yield k, i, 0.0
        else:
            k = int(np.argmax(over))
            yield i, j[k], over[k] / n[i]


def searched(rows: DataFrame, percent: int, turn: str) -> DataFrame:
    """rows (token, size of the block, nid, n, point, comp) to pairs (a, b, margin) of their blocks."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("token", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "nid", "n", "point", "comp")

    def run(batches):
        held: list = []

        def found(part):
            start = 0
            key = np.stack([part.column(c).to_numpy() for c in ("token", "low", "high")])
            ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), part.num_rows]
            nid, n, comp = [part.column(c).to_numpy() for c in ("nid", "n", "comp")]
            packed = part.column("point").to_pylist()
            out: list = []
            for end in ends:
                if end - start > 1:
                    points = np.stack([coordinates(p) for p in packed[start:end]])
                    out.extend((nid[start + i], nid[start + j], m) for i, j, m in block_pairs(n[start:end], points, comp[start:end], percent, turn))
                start = end
                if len(out) > 50_000:
                    yield out
                    out = []
            yield out

        def pairs(out):
            a, b, m = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.float64())], names=["a", "b", "margin"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            key = [whole.column(c).to_numpy() for c in ("token", "low", "high")]
            # The last block of a batch may go on in the next one.
            cut = int(np.searchsorted(~np.logical_and.reduce([k == k[-1] for k in key])[::-1], True))
            rest = whole.num_rows - cut
            if rest:
                for out in found(whole.slice(0, rest)):
                    yield pairs(out)
            held = whole.slice(rest).to_batches()
        if held:
            for out in found(pa.Table.from_batches(held).combine_chunks()):
                yield pairs(out)

    return rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(run, _EDGES)


def _with_components(rows: DataFrame, stars: DataFrame | None) -> DataFrame:
    if stars is None:
        return rows.withColumn("comp", F.col("nid"))
    return rows.join(stars.select(F.col("a").alias("nid"), F.col("b").alias("root")), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")


def wanted_sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(nid, shingles) of the wanted nodes (id, th, nid, node), from the text of one member.

    Key and hash of the text name the member, so that rows of one key, and of none, don't meet all nodes of that key.
    """

    def run(batches):
        for batch in batches:
            nids, sets = [], []
            for nid, node, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(value.as_py() or b"", words)
                if len(s) and node_of(s) == node:  # another text may have the hash
                    nids.append(nid)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["nid", "shingles"])

    both = [F.col("id"), F.col("th")]
    texts = maybe_in(docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").cast("binary").alias("text")), both, wanted, both)
    both = wanted.alias("w").hint("merge").join(texts.alias("t"), (F.col("w.th") == F.col("t.th")) & F.col("w.id").eqNullSafe(F.col("t.id"))).select("nid", "node", "text")
    return both.mapInArrow(run, "nid long, shingles array<long>")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    rows, rows_path = written(counted(docs, key, text, words), "rows")
    rows = rows.filter("bucket is null").select("id", "th", "n", "node")
    ranks = bucket_ranks(spark.read.parquet(rows_path))
    nodes, nodes_path = written(distinct_sets(docs, text, words, percent, ranks), "nodes")
    blocks, blocks_path = shared_blocks(nodes)
    small = nodes.select("nid", "n", "point")
    stars, sets, paths = None, None, [nodes_path, blocks_path]
    tried = []
    for turn in TURNS:
        if stars is not None:
            # Components only grow, so a block of one component is done with for all later turns.
            named, named_path = written(_with_components(blocks, stars), "named")
            mixed = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
            blocks, path = written(named.join(mixed, "token", "left_semi"), "mixed")
            drop(spark, named_path, paths.pop())
            paths.append(path)
            pairs = searched(blocks.join(maybe_in(small, [F.col("nid")], blocks, [F.col("nid")]), "nid"), percent, turn)
            blocks = blocks.drop("comp")
        else:
            pairs = searched(_with_components(blocks.join(small.hint("merge"), "nid"), None), percent, turn)
        if turn == "all":
            # Of what two blocks or two nodes propose alike, and what was tried before, nothing is verified again.
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            before = tried[0].unionByName(tried[1]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            pairs, path = written(pairs.join(before, ["a", "b"], "left_anti"), "pairs")
        else:
            every, every_path = written(pairs, "proposed")
            if sets is None:
                # Whoever the bound lets link with anyone stands in these rows, so no later turn needs another set.
                ends = every.select(F.col("a").alias("nid")).unionByName(every.select(F.col("b").alias("nid"))).distinct()
                ids = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "th")).alias("m"))
                wanted, wanted_path = written(nodes.select("nid", "node").join(ends.hint("merge"), "nid", "left_semi").join(ids.hint("merge"), "node").select("m.id", "m.th", "nid", "node"), "wanted")
                sets, sets_path = written(wanted_sets(docs, key, text, words, wanted).dropDuplicates(["nid"]), "sets")
                paths.insert(0, sets_path)
                drop(spark, wanted_path)
            pairs, path = written(every.groupBy("a").agg(F.max_by("b", F.struct("margin", "b")).alias("b")), "pairs")
            drop(spark, every_path)
        tried.append(pairs)
        paths.insert(0, path)
        edges = verified(pairs, sets, percent)
        old = stars
        stars, stars_path = graph.components(edges if old is None else edges.unionByName(old))
        paths.insert(0, stars_path)
    owned = _with_components(rows.join(nodes.select("node", "nid"), "node", "left"), stars)
    # Both sides of the last join are plain tables, so that Spark can split a component of very many rows.
    owned, owned_path = written(owned, "owned")
    first, first_path = written(owned.filter("nid is not null").groupBy("comp").agg(F.min("id").alias("least")), "firsts")
    result, _ = written(owned.join(first.hint("merge"), "comp", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")), "linked")
    drop(spark, rows_path, owned_path, first_path, *paths)
    return result


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Both joins are of shuffled sides, so that Spark splits a node of many pairs."""
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid")))
    sets = maybe_in(sets, [F.col("nid")], ends, [F.col("nid")])
    left, right = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").hint("merge").join(left, "a").join(right.hint("merge"), "b").withColumn("i", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.filter(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")
