"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams, within word bounds, that occur in it. A worker works out the n-grams of
a word once; a text's are the union of its distinct words'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import Memory, cut, held, need, remainder, remainder_col, table, texts_of
from mirrorfold.llm.tokens import arrow, rows

GRAMS, BITS = (2, 3, 4, 5), 18
FIT_ROWS, FIT_GRAMS = 6_000, 24_000_000  # labelled texts that the fit takes at most, and their n-grams together (4 bytes each)
AT_ONCE = 1 << 20  # n-grams that a step of the fit looks at together
THRESHOLD = 0.3
SMOOTH, STEPS = 10.0, 60  # added to an n-gram's counts; few steps, so that odd labels aren't learnt by heart
KNOWN = 64 << 20  # bytes that a worker's remembered words and their n-grams take
LONG = 4096  # bytes of a word whose n-grams are worked out together
STRIP = b""".,;:!?|#*%&$"()[]{}<>~^_=+/\\'`-"""


def words(text: bytes | None) -> set[bytes]:
    """The distinct words, lower-case, without the signs around them."""
    return {w.strip(STRIP) for w in set((text or b"").decode().lower().encode().split())} - {b""}


def grams(word: bytes) -> bytes:
    """Hashed n-grams of a word with its bounds, as 32-bit integers; a long word's are distinct, part by part."""
    from zlib import crc32

    w, mask = b"\x02" + word + b"\x03", (1 << BITS) - 1
    made = []
    for at in range(0, len(w), LONG):
        part = w[at : at + LONG + max(GRAMS) - 1]
        found = [crc32(part[k : k + n]) for n in GRAMS for k in range(min(LONG, len(part) - n + 1))]
        made.append(np.array([(h ^ h >> BITS) & mask for h in found], np.int32))
        if len(made) > 64:
            made = [np.unique(np.concatenate(made))]
    return np.concatenate(made).tobytes()


class Features:
    """The distinct hashed n-grams of texts, with a memory of words."""

    def __init__(self):
        self.memory = Memory(KNOWN)
        self.place = np.zeros(1 << BITS, np.int32)

    def of(self, text: bytes | None) -> np.ndarray:
        found = [self._piece(p) for p in texts_of(text)]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))

    def _piece(self, text: bytes) -> np.ndarray:
        some, memory = words(text), self.memory.room()
        fresh = {w: grams(w) for w in some.difference(memory)}
        flat = np.frombuffer(b"".join([memory[w] if w in memory else fresh[w] for w in some]), np.int32)
        self.memory.keep(fresh.items())
        turn = np.arange(len(flat), dtype=np.int32)
        self.place[flat] = turn
        return np.sort(flat[self.place[flat] == turn])


def of_worker() -> Features:
    return held("toxicity", Features)


def fitted(texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, smooth: float = SMOOTH) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on n-grams times their log-count ratios: full-batch steps with momentum.

    texts: the n-grams of each. A pass goes over blocks of AT_ONCE n-grams, or one text, so that besides the
    texts only a block's numbers are held.
    """
    size, n, y = 1 << BITS, len(labels), labels.astype(np.float64)
    sizes = np.array([len(t) for t in texts])
    block = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]

    def blocks():
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield at, end, np.concatenate(texts[at:end]), np.repeat(np.arange(end - at, dtype=np.int32), sizes[at:end])

    seen, bad = np.zeros(size), np.zeros(size)
    for at, end, flat, row in blocks():
        seen += np.bincount(flat, minlength=size)
        bad += np.bincount(flat, y[at:end][row], size)
    good = seen - bad
    ratio = np.log((bad + smooth * bad.sum() / good.sum()) / bad.sum()) - np.log((good + smooth) / good.sum())
    rate = 2.0 * n / max(np.sum(seen * ratio**2), 1e-9)
    w, v, bias, vb = np.zeros(size), np.zeros(size), float(np.log(y.mean() / (1 - y.mean()))), 0.0
    for _ in range(steps):
        slope, gaps, scaled = np.zeros(size), 0.0, w * ratio
        for at, end, flat, row in blocks():
            gap = 1 / (1 + np.exp(-np.clip(np.bincount(row, scaled[flat], end - at) + bias, -30, 30))) - y[at:end]
            slope += np.bincount(flat, gap[row], size)
            gaps += gap.sum()
        v = 0.9 * v - rate / n * ratio * slope
        vb = 0.9 * vb - 0.05 * gaps / n
        w, bias = w + v, bias + vb
    return w * ratio, bias


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Fit in one task on at most `most` labelled texts and FIT_GRAMS of their n-grams, the first by a hash of their ids.

    The task holds the n-grams (96 MB at most, 1 MB for the longest text) and a block's numbers.
    """
    chosen = need(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder_col("doc_id", 4) != 2))
    chosen = cut(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    told = need(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    counted = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.binary())])

    def count(batches):
        of = of_worker().of
        yield from arrow(((d, toxic, of(text).tobytes()) for d, toxic, text in rows(batches, "doc_id", "toxic", "text")), counted, 256)

    model = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])

    def fit(batches):
        texts, told, size = [], [], 0
        for batch in batches:  # in order of the hash; the arrays lie in the batches' own memory
            for toxic, at in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = np.frombuffer(at.as_buffer(), np.int32)
                size += len(text)
                if size > FIT_GRAMS:
                    break
                texts.append(text)
                told.append(toxic)
            if size > FIT_GRAMS:
                break
        if len(set(told)) == 2:
            w, bias = fitted(texts, np.array(told))
        else:  # one label or none: its share alone
            w, bias = np.zeros(1 << BITS), (np.log(99.0) if told and told[0] else -np.log(99.0))
        yield from arrow([(w.astype(np.float32).tobytes(), float(bias))], model)

    counts = told.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(count, "doc_id long, toxic int, at binary")
    weights, bias = counts.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("at")).mapInArrow(fit, "weights binary, bias double").first() or (None, -np.log(99.0))
    return (np.zeros(1 << BITS, np.float32) if weights is None else np.frombuffer(weights, np.float32)), bias


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD) of every row's whole text.

    Labels other than 0 and 1, and those of held-out or null ids, teach nothing; an id with both labels is
    toxic; the rows of a repeated id all teach. Null and empty texts get the bias alone. Without two labels
    to learn from every score is 0.01, or 0.99 where all are toxic. No rows: no result rows.
    """
    weights, bias = train(docs, labels, most)
    weights, schema = weights.astype(np.float64), pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def make(batches):
        of = of_worker().of

        def out():
            for doc_id, text in rows(batches, "doc_id", "text"):
                z = bias + float(weights[of(text)].sum())
                score = float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))
                yield doc_id, remainder(doc_id, 4) == 2, score, int(score >= THRESHOLD)

        yield from arrow(out(), schema)

    return need(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(make, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier does not reject, whole; the same features, in the pass that keeps them.

    Columns of any name pass through; null, empty and repeated rows are scored as in scored().
    """
    weights, bias = train(docs, labels, most)
    weights = weights.astype(np.float64)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        of, least = of_worker().of, float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return pa.array([bias + float(weights[of(t.as_py())].sum()) < least for t in texts], pa.bool_())

    return docs.where(clean(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
