"""A hidden Markov language model, trained by Baum-Welch counts that partitions gather and Spark sums.

A word is emitted in two steps: the state draws a class of words, the class draws the word by its smoothed
share of the corpus. Classes are hashes of words, a fixed number at any size, so the model that goes to
every task is bounded, while the counts behind the shares cover every word of the training texts. Texts
are kept as chunks of token numbers with a dictionary a chunk; only the dictionaries meet the corpus
counts, a row for each word of a chunk, not for each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirrorfold.llm.common import bounded, need, remainder, scratch, table, trim
from mirrorfold.llm.tokens import arrow, rows

STATES, CLASSES, ROUNDS = 4, 8192, 4
UNKNOWN, END = 0, 1  # the first two classes
ADD = 0.1  # to every count
PRIOR = 1000  # tokens by the corpus shares that each state counts besides its own
CHUNK = 12 << 20  # bytes of text
READ = 2 << 20  # bytes of an Arrow batch
TOKENS = 1 << 18  # that one batch of recursions takes at most, or one document


def class_of(word: bytes) -> int:
    import xxhash

    return END if not word else 2 + xxhash.xxh3_64_intdigest(word) % (CLASSES - 2)


def chunks(docs: DataFrame, modulus: int) -> DataFrame:
    """Two kinds of rows: a chunk's documents (ids as bytes), and the words of its dictionary with their training counts.

    spot: a word's class, times 2**32, and its place in the dictionary.
    """
    import pyarrow as pa

    ints = pa.list_(pa.int64())
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", ints), ("lengths", ints), ("ids", pa.binary()), ("word", pa.binary()), ("spot", pa.int64()), ("c", pa.int64())])

    def make(batches) -> Iterator:
        import zstandard
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held, train, size = [], [], [], {b"": 0}, [], 0

        def flush():
            flat = np.concatenate(ids)
            taught = np.concatenate([x for x, t in zip(ids, train, strict=True) if t] or [np.zeros(0, np.uint32)])
            counts = np.bincount(taught, minlength=len(held))
            name, words = task << 32 | made, list(held)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([name], [doc_ids], [lengths], [zstandard.compress(flat, 1)], [None], [None], [None]), schema.types, strict=True)], schema=schema)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.nulls(n, ints), pa.nulls(n, ints), pa.nulls(n, pa.binary()), pa.array(some, pa.binary()), pa.array(np.fromiter(map(class_of, some), np.int64, n) << 32 | np.arange(at, at + n)), pa.array(counts[at : at + n], pa.int64())], schema=schema)

        for doc_id, text in rows(batches, "doc_id", "text"):
            words = (text or b"").lower().split()
            for w in set(words).difference(held):
                held[w] = len(held)
            doc_ids.append(doc_id)
            lengths.append(len(words) + 1)
            train.append(remainder(doc_id, modulus) != 0)
            ids.append(np.fromiter(map(held.__getitem__, [*words, b""]), np.uint32, len(words) + 1))
            size += len(text or b"")
            if size >= CHUNK:
                yield from flush()
                made += 1
                doc_ids, lengths, ids, held, train, size = [], [], [], {b"": 0}, [], 0
        if doc_ids:
            yield from flush()
        doc_ids, lengths, ids, held, train = [], [], [], {}, []
        trim()

    return need(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(make, "chunk long, doc_ids array<long>, lengths array<long>, ids binary, word binary, spot long, c long")


def classed(docs: DataFrame, told: DataFrame, n: int, v: int, shares: np.ndarray) -> DataFrame:
    """Chunks with classes for words: doc_ids, lengths, classes (bytes), and each document's known, base and rest.

    rest: log10 of the words' shares within their classes.
    """
    import pyarrow as pa

    ints, reals = pa.list_(pa.int64()), pa.list_(pa.float64())
    schema = pa.schema([("doc_ids", ints), ("lengths", ints), ("classes", pa.binary()), ("known", ints), ("base", reals), ("rest", reals)])
    log_shares = np.log10(shares)

    def make(left, right):
        import zstandard

        size = right.num_rows
        c, kinds = np.zeros(size, np.int64), np.zeros(size, np.uint16)
        spot = right.column("spot").to_numpy()
        at = spot & 0xFFFFFFFF
        c[at], kinds[at] = right.column("total").to_numpy(), spot >> 32
        kinds[c == 0] = UNKNOWN
        base = np.log10((c + ADD) / (n + ADD * (v + 1)))
        out = []
        for doc_ids, lengths, ids in rows(left.to_batches(), "doc_ids", "lengths", "ids"):
            flat = np.frombuffer(zstandard.decompress(ids), np.uint32)
            firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            out.append((doc_ids, lengths, zstandard.compress(kinds[flat], 1), np.add.reduceat((c > 0)[flat], firsts, dtype=np.int64), np.add.reduceat(base[flat], firsts), np.add.reduceat((base - log_shares[kinds])[flat], firsts)))
        return pa.Table.from_batches(list(arrow(out, schema)), schema)

    return docs.groupBy("chunk").cogroup(told.select("chunk", "spot", "total").groupBy("chunk")).applyInArrow(make, "doc_ids array<long>, lengths array<long>, classes binary, known array<long>, base array<double>, rest array<double>")


def batches_of(lengths: np.ndarray, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """The chosen documents by descending length, in batches of bounded tokens."""
    order = chosen[np.argsort(-lengths[chosen], kind="stable")]
    at = 0
    while at < len(order):
        sums = np.cumsum(lengths[order[at : at + TOKENS]])
        end = at + max(1, int(np.searchsorted(sums, TOKENS, side="right")))
        yield order[at:end]
        at = end


class Model:
    """start (states), moves (states x states), emits (states x classes); rows sum to 1."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES) -> Model:
        """Sticky states whose classes are the corpus shares, each a little off in its own fixed way."""
        tilt = shares * np.exp(np.random.default_rng(7).normal(0, 0.5, (states, len(shares))))
        moves = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 if states > 1 else 1)
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), tilt / tilt.sum(1, keepdims=True))

    def forward(self, kinds: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Natural log likelihoods of documents by descending length, by the scaled forward recursion.

        What needs no recursion is worked out for all places at once, place by place of as many documents as reach it.
        keep: also where a place's rows end, their kinds, emissions, scaled forward rows and scales.
        """
        reach = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # documents longer than t
        ends = np.cumsum(reach)
        doc = np.arange(ends[-1]) - np.repeat(ends - reach, reach)
        kind = kinds[firsts[doc] + np.repeat(np.arange(len(reach)), reach)]
        e = np.ascontiguousarray(self.emits.T)[kind]
        alphas, scales, ones = np.empty_like(e) if keep else None, np.empty(len(e)), np.ones(len(self.start))
        at, alpha = 0, None
        for end in ends.tolist():
            alpha = (self.start if alpha is None else alpha[: end - at] @ self.moves) * e[at:end]
            scale = np.dot(alpha, ones, out=scales[at:end])
            alpha = np.divide(alpha, scale[:, None], out=alphas[at:end] if keep else alpha)
            at = end
        total = np.bincount(doc, np.log(scales), len(firsts))
        return (total, (ends, kind, e, alphas, scales)) if keep else total

    def gather(self, kinds: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, into: list[np.ndarray]) -> None:
        """Add the documents' expected counts of starts, moves and emissions."""
        _, (ends, kind, ahead, alphas, scales) = self.forward(kinds, firsts, lengths, keep=True)
        starts, moves, emits = into
        ahead /= scales[:, None]
        betas, back = np.ones_like(alphas), np.ascontiguousarray(self.moves.T)
        at = [0, *ends.tolist()]
        for t in range(len(ends) - 1, 0, -1):
            here = ahead[at[t] : at[t + 1]]
            here *= betas[at[t] : at[t + 1]]
            np.matmul(here, back, out=betas[at[t - 1] : at[t - 1] + len(here)])
        n = np.diff(at)
        before = np.arange(at[1], at[-1]) - np.repeat(n[:-1], n[1:])  # the same document's row a place earlier
        moves += alphas[before].T @ ahead[at[1] :] * self.moves
        betas *= alphas
        starts += betas[: at[1]].sum(axis=0)
        for s in range(len(self.start)):
            emits[s] += np.bincount(kind, betas[:, s], emits.shape[1])

    def learnt(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Model:
        """The model of the counts. States also saw PRIOR tokens by the corpus shares; the unknown class, which no
        training text shows, keeps its share in each."""
        emits = emits + PRIOR * shares
        emits[:, UNKNOWN] = 0
        emits *= (1 - shares[UNKNOWN]) / emits.sum(1, keepdims=True)
        emits[:, UNKNOWN] = shares[UNKNOWN]
        moves, starts = moves + 0.1, starts + 0.1
        return Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits)


def opened(lengths: list[int], classes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    n = np.array(lengths, np.int64)
    return np.frombuffer(zstandard.decompress(classes), np.uint16), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n


def train(kept: DataFrame, shares: np.ndarray, modulus: int, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents; a round is one pass, summed by Spark to a row a class."""
    import pyarrow as pa

    schema = pa.schema([("row", pa.int32()), ("counts", pa.list_(pa.float64()))])
    model, size = Model.first(shares, states), len(shares)

    def gathered(model: Model):
        def make(batches):
            into = [np.zeros(states), np.zeros((states, states)), np.zeros((states, size))]
            for doc_ids, lengths, classes in rows(batches, "doc_ids", "lengths", "classes"):
                kinds, firsts, n = opened(lengths, classes)
                chosen = np.array([k for k, d in enumerate(doc_ids) if remainder(d, modulus) != 0], np.int64)
                for some in batches_of(n, chosen):
                    model.gather(kinds, firsts[some], n[some], into)
            seen = np.flatnonzero(into[2].sum(axis=0))
            out = [(-1, into[0].tolist()), *((-2 - s, into[1][s].tolist()) for s in range(states)), *((int(k), into[2][:, k].tolist()) for k in seen)]
            trim()
            yield from arrow(out, schema)

        return make

    for _ in range(rounds):
        part = kept.select("doc_ids", "lengths", "classes").mapInArrow(gathered(model), "row int, counts array<double>")
        with bounded(kept.sparkSession, READ):
            sums = part.groupBy("row").agg(*(F.sum(F.col("counts")[s]).alias(f"s{s}") for s in range(states))).collect()  # a row a class
        got = {r["row"]: np.array(r[1:]) for r in sums}
        emits = np.zeros((states, size))
        for k, x in got.items():
            if k >= 0:
                emits[:, k] = x
        none = np.zeros(states)
        model = model.learnt(got.get(-1, none), np.stack([got.get(-2 - s, none) for s in range(states)]), emits, shares)
    return model


def scored(docs: DataFrame, modulus: int = 10, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per document its tokens, known tokens, base score and the model's log10 probability of the whole text.

    Held out, and so not learnt from: crc32 of the id as text, modulo `modulus`, is 0 (a null id counts as
    the empty text, whose crc32 is 0). Null and empty texts are the end alone. Repeated rows count and are
    scored each. No training rows: counts of 0, every token unknown. No rows: no result rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    folder = scratch(spark, "hmm")
    with bounded(spark, READ):
        chunks(docs, modulus).write.parquet(f"{folder}/chunks")
    words = spark.read.parquet(f"{folder}/chunks").where("spot IS NOT NULL").select("chunk", "spot", "word", "c")
    held = spark.read.parquet(f"{folder}/chunks").where("spot IS NULL").select("chunk", "doc_ids", "lengths", "ids")
    # one shuffle by word: a word has a row for each chunk at most, and its first row stands for it
    of = Window.partitionBy("word").orderBy("chunk")  # one order for both
    total = F.sum("c").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    words.select("chunk", "spot", total.alias("total"), (F.row_number().over(of) == 1).alias("first")).write.parquet(f"{folder}/told")
    told = spark.read.parquet(f"{folder}/told")
    known = told.where("first AND total > 0")
    n, v = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    shares = np.zeros(CLASSES)
    for r in known.groupBy(F.shiftright("spot", 32).alias("class")).agg(F.sum("total").alias("c"), F.count("*").alias("v")).collect():  # a row a class
        shares[r["class"]] = (r["c"] + ADD * r["v"]) / (n + ADD * (v + 1))
    shares[UNKNOWN] = ADD / (n + ADD * (v + 1))
    shares = np.maximum(shares, 1e-300)
    with bounded(spark, READ):
        classed(held, told, n, v, shares).write.parquet(f"{folder}/classed")
    kept = spark.read.parquet(f"{folder}/classed")
    model = train(kept, shares, modulus, states, rounds)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def make(batches):
        for doc_ids, lengths, classes, known, base, rest in rows(batches, "doc_ids", "lengths", "classes", "known", "base", "rest"):
            kinds, firsts, sizes = opened(lengths, classes)
            score = np.zeros(len(sizes))
            for some in batches_of(sizes, np.arange(len(sizes))):
                score[some] = model.forward(kinds, firsts[some], sizes[some])
            score = score / np.log(10) + np.array(rest)
            yield from arrow(((d, remainder(d, modulus) == 0, t, k, n, b, s) for d, t, k, b, s in zip(doc_ids, lengths, known, base, score.tolist(), strict=True)), schema)

    return kept.mapInArrow(make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
