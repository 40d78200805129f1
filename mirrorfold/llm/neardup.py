"""Near-duplicate groups by one-permutation MinHash with optimal densification.

One hash of each shingle gives the whole signature: its high bits choose a bin, its low bits compete
there; an empty bin borrows from the first filled one along a fixed random order of its own. Bands of the
signature are bucket keys. Equal sets are one node from the start. A bucket emits a star: an edge from
each node to its least; edges are measured on the full sets, and the near ones link.

A star can miss a link between two of its leaves. So the star's measured edges also tell families, whose
members are KIN percent alike with a centre; within a family that is still in parts, the smaller parts meet
the whole, block against block, and only links come out. Two linked sets are left in different families
only if every bucket that they share has a centre alien to both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import cut, need, table
from mirrorfold.llm.shingles import mixed, shingle_sets
from mirrorfold.llm.tokens import arrow
from mirrorfold.operators.closure import components

BINS, ROWS = 128, 4  # bins of the signature; rows of a band
PERCENT, WORDS, KIN = 80, 5, 40
BLOCK = 1024  # nodes of a family that meet as many others at once
BROADCAST = 500_000  # ids that go to every task at most (8 bytes each); more go by a shuffle

ORDER = np.stack([np.random.default_rng(1000 + k).permutation(BINS) for k in range(BINS)])
EDGES = (np.arange(BINS, dtype=np.uint64)) << np.uint64(64 - BINS.bit_length() + 1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set of hashes."""
    at = np.searchsorted(hashes, EDGES)
    end = np.concatenate([at[1:], [len(hashes)]])
    filled = end > at
    source = ORDER[np.arange(BINS), filled[ORDER].argmax(axis=1)]
    return hashes[at[np.where(filled, np.arange(BINS), source)]]


def band_keys(values: np.ndarray) -> list[int]:
    keys = np.arange(BINS // ROWS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(5) + values.reshape(-1, ROWS)[:, k])
    return keys.view(np.int64).tolist()


def _texts(docs: DataFrame) -> DataFrame:
    return need(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))


def _sets(batches, width: int):
    import xxhash

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, len(ids), 512):
            texts = batch.column(1).slice(at, 512).to_pylist()
            for doc_id, hashes in zip(ids[at : at + 512], shingle_sets(texts, width), strict=True):
                yield doc_id, hashes, xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), fp (128 bits of the set, null if empty), keys (of the bands)."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def make(batches):
        yield from arrow(((i, len(h), fp, band_keys(signature(h)) if len(h) else None) for i, h, fp in _sets(batches, width)), schema, 2048)

    return _texts(docs).mapInArrow(make, "doc_id long, n long, fp binary, keys array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, grams (hashes as bytes) of the wanted nodes (node, doc_id, fp), hashed anew from their texts."""
    import pyarrow as pa

    schema = pa.schema([("fp", pa.binary()), ("grams", pa.binary())])

    def make(batches):
        yield from arrow(((fp, h.tobytes()) for _, h, fp in _sets(batches, width)), schema, 256)

    wanted = nodes.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST else wanted
    found = _texts(docs).join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(make, "fp binary, grams binary")
    return found.join(nodes.select("fp", "node"), "fp").groupBy("node").agg(F.first("grams").alias("grams"))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with the sizes of their sets' intersection and union: same, all."""
    import pyarrow as pa

    schema = pa.schema([(x, pa.int64()) for x in ("u", "v", "same", "all")])

    def make(batches):
        for batch in batches:
            out = []
            for u, v, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                out.append((u, v, same, len(both) - same))
            yield from arrow(out, schema)

    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(make, "u long, v long, same long, all long")


def across_parts(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between the parts (root) of families (kin): v is the root of a part that u has a link into.

    members: node, doc_id, fp, kin, root. The largest part meets only the others.
    """
    import pyarrow as pa

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    parts = members.groupBy("kin", "root").agg(F.count("*").alias("m"))
    torn = parts.groupBy("kin").agg(F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("parts"), F.sum("m").alias("size")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    torn = torn.select("kin", F.col("x.root").alias("largest"), blocks(F.col("size")).alias("rights"), blocks(F.col("size") - F.col("x.m")).alias("lefts"))
    within = cut(members.join(torn, "kin"))
    if within.isEmpty():
        return within.select(F.col("node").alias("u"), F.col("root").alias("v")).limit(0)
    within = within.join(cut(full_sets(docs, within.select("node", "doc_id", "fp"), width)), "node")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = within.where("root <> largest").select("kin", dealt("lefts").alias("l"), every("rights").alias("r"), "node", "root", "grams")
    right = within.select(F.col("kin").alias("of"), every("lefts").alias("l"), dealt("rights").alias("r"), F.col("root").alias("part"), F.col("grams").alias("set"))

    def meet(a, b):
        sets = [np.frombuffer(x, np.uint64) for x in b.column("set").to_pylist()]
        roots, sizes = np.asarray(b.column("part")), np.array([len(x) for x in sets], np.int64)
        grams = np.concatenate(sets or [np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], np.repeat(np.arange(len(sets)), sizes)[order]
        out = []
        for u, root, x in zip(a.column("node").to_pylist(), a.column("root").to_pylist(), a.column("grams").to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint64)
            first, end = np.searchsorted(grams, x, "left"), np.searchsorted(grams, x, "right")
            n = end - first
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            same = np.bincount(owner[at], minlength=len(sets))
            near = (100 * same >= percent * (len(x) + sizes - same)) & (roots != root)
            out.extend((u, int(v)) for v in np.unique(roots[near]))
        return pa.Table.from_batches(list(arrow(out, schema)), schema)

    return left.groupBy("kin", "l", "r").cogroup(right.groupBy("of", "l", "r")).applyInArrow(meet, "u long, v long")


def groups(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id of its group), kept (it is that one).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. A null
    doc_id is linked with nothing and kept, its component_id null. Repeated rows have equal sets, so equal
    ids; an id with several texts belongs to the groups of all of them. No rows: no result rows.
    """
    made = cut(signed(docs, width))
    real = made.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    least = F.min(F.struct("doc_id", "n", "keys")).alias("x")
    nodes = cut(real.groupBy("fp").agg(least).select("fp", "x.*", F.monotonically_increasing_id().alias("node")))
    bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("nodes")).where("nodes > 1").select("key", "head")
    shared = bands.join(heads, "key").select("node", "n", F.col("head.node").alias("centre"), F.col("head.n").alias("centre_n"))
    kin_sizes = 100 * F.least("n", "centre_n") >= KIN * F.greatest("n", "centre_n")  # others are no kin
    star = cut(shared.where((F.col("node") != F.col("centre")) & kin_sizes).select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct())

    def measure(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        return cut(measured(pairs, cut(full_sets(docs, cut(nodes.join(ends, "node").select("node", "doc_id", "fp")), width))))

    # An id of several texts ties their nodes
    twice = real.select("doc_id", "fp").distinct().join(real.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id"), "doc_id").join(nodes.select("fp", "node"), "fp").select("doc_id", "node")
    ties = twice.join(twice.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")
    linked = lambda m, least: m.where(100 * F.col("same") >= least * F.col("all")).select("u", "v")
    star = measure(star)
    links = cut(linked(star, percent).unionByName(ties))
    roots, kin = cut(components(links)), components(linked(star, KIN)).select("node", F.col("root").alias("kin"))
    kin = cut(kin.join(roots, "node", "left").select("node", "kin", F.coalesce("root", "node").alias("root")))
    more = cut(across_parts(nodes.select("node", "doc_id", "fp").join(kin, "node"), docs, width, percent))

    if not more.isEmpty():
        roots = cut(components(links.unionByName(more)))

    owned = nodes.select("fp", "node", "doc_id").join(roots, "node", "left").select("fp", "doc_id", F.coalesce("root", "node").alias("root"))
    named = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = owned.join(named, "root").select("fp", "component_id")
    out = made.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    mine = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each near-duplicate group: the least id. Null ids all stay.

    Rows of one id and text are one document, the least of their hashes stands for it; an id whose rows hold
    several texts names several documents, which all stay or all go. Columns of any name pass through.
    """
    gone = groups(docs, width, percent).where("NOT kept").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").alias("id_"), F.sha2(F.col("text"), 256).alias("text_"), F.struct("*").alias("row_")).join(gone.withColumnRenamed("doc_id", "id_"), "id_", "left_anti")
    one = rows.where("id_ IS NOT NULL").groupBy("id_", "text_").agg(F.min_by("row_", F.xxhash64("row_")).alias("row_"))
    return one.select("row_.*").unionByName(rows.where("id_ IS NULL").select("row_.*"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                 WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared_n >= 80 * (x.n + y.n - shared_n)),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
