"""Language-model scores of whole texts: a unigram base and a hidden Markov model.

Words are runs without ASCII white space, A-Z in lower case; an end follows the last word. The corpus
statistics are counts of every word of every learning document. A word over ``LONGEST_WORD`` bytes is known by its
sha256 behind a space, which no word holds, so words of any length take bounded space. Beside its learning count each
word has its count in all rows. The at most ``FREQUENT`` words most seen in all rows, unknown ones and long ones
included, are broadcast; all others meet their counts in a shuffle join. There none is hot: a word below the cut
is at most about one in ``FREQUENT`` of all tokens.

The hidden Markov model emits word classes: the most frequent words are a class each, all others fall into
``HASHED`` classes by their crc32. A state draws a class, the class draws the word with an absolute
discount, whose mass goes to the one unknown word of the class; so probabilities sum to one over known words and
one unknown word per class. Baum-Welch runs over all learning documents, cut into windows of ``WINDOW`` tokens for
training only: each task sums expected counts, Spark adds them by index, and the driver gets one number per
parameter. Scores use no windows: the scaled forward recursion covers each text from its first word to its end.

Defined results: null and empty texts are the end alone; without learning text all counts are 0 and the model's
score equals the base score; a null doc_id counts as an empty text in the split; repeated rows are scored each; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, id_remainder, slices, staged, text_bytes

FREQUENT = 200_000
LONGEST_WORD = 64
OWN, HASHED = 2048, 512
STATES, ROUNDS, WINDOW, SEED = 8, 4, 128, 5
DISCOUNT = 0.5
HELD_WORDS = 300_000
END = b""

CODED = (
    "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, "
    "classes binary, rare array<struct<word: binary, n: int>>"
)


def words_of(body: bytes) -> list[bytes]:
    """The words of a text, long ones by their digests."""
    words = body.lower().split()
    if len(body) > LONGEST_WORD:
        for k, word in enumerate(words):
            if len(word) > LONGEST_WORD:
                words[k] = b" " + hashlib.sha256(word).digest()
    return words


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each split, in learning rows and in all; handed on whenever ``HELD_WORDS`` words are held."""
    from collections import Counter

    learned: Counter = Counter()
    others: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list({**learned, **others})
        c = [learned[w] for w in words]
        seen = [n + others[w] for n, w in zip(c, words, strict=True)]
        return arrow_batch(["word", "c", "seen"], [pa.binary(), pa.int64(), pa.int64()], [words, c, seen])

    for batch in slices(batches, "body"):
        for body, learn in zip(batch.column("body").to_pylist(), batch.column("learn").to_pylist(), strict=True):
            held = learned if learn else others
            held.update(words_of(body))
            held[END] += 1
        if len(learned) + len(others) > HELD_WORDS:
            yield out()
            learned, others = Counter(), Counter()
    yield out()


def class_of_rare() -> Column:
    return F.crc32("word") % HASHED


class WordStatistics:
    """What a task needs of the frequent words: counts, classes, log probabilities."""

    def __init__(self, frequent: list[tuple[bytes, int]], n: int, v: int, hashed: dict[int, tuple[int, int]]):
        self.n, self.v = n, v
        ranked = sorted(frequent, key=lambda x: (x[0] != END, -x[1], x[0]))
        self.hashed = hashed
        self.index = {word: k for k, (word, _) in enumerate(ranked)}
        counts = np.array([c for _, c in ranked] or [0], float)
        self.own = min(OWN, sum(c > 0 for _, c in ranked))
        self.known = counts > 0
        self.base = np.log10((counts + 1) / (n + v + 1))
        self.classes = np.array([k if k < self.own else self.rare_class(w) for k, (w, _) in enumerate(ranked)] or [0], np.int64)
        within = np.zeros(len(counts))
        for k, (word, c) in enumerate(ranked):
            if k >= self.own:
                total, kinds = hashed.get(zlib.crc32(word) % HASHED, (0, 0))
                within[k] = np.log10((c - DISCOUNT if c else kinds * DISCOUNT) / total) if total else 0.0
        self.within = within

    @property
    def n_classes(self) -> int:
        return self.own + HASHED

    def rare_class(self, word: bytes) -> int:
        return self.own + zlib.crc32(word) % HASHED

    def frequencies(self, frequent: list[tuple[bytes, int]]) -> np.ndarray:
        """Share of each class in the corpus, never 0."""
        out = np.full(self.n_classes, 1e-3)
        for word, c in frequent:
            k = self.index[word]
            if k < self.own:
                out[k] += c
        for k, (total, _) in self.hashed.items():
            out[self.own + k] += total
        return out / out.sum()


def frequency_cut(counts: DataFrame, size: int) -> int:
    """The smallest count of all rows, on a logarithmic scale, that at most ``size`` words reach."""
    step = F.floor(F.log2(F.col("seen").cast("double")) * 8)
    found = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for s, n in found:
        if total + n > size:
            break
        total, cut = total + n, s
    return int(np.ceil(2 ** (cut / 8))) if cut is not None else 1 << 62


def encode_texts(batches: Iterator[pa.RecordBatch], stats: WordStatistics) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    names = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "classes", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type]
    index, get = stats.index, stats.index.get
    for batch in slices(batches, "body"):
        out: list[list] = [[] for _ in range(6)]
        for body in batch.column("body").to_pylist():
            words = words_of(body)
            words.append(END)
            places = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            common = places[places >= 0]
            classes = stats.classes[places]
            missing = np.flatnonzero(places < 0)
            rare: Counter = Counter()
            for k in missing.tolist():
                classes[k] = stats.rare_class(words[k])
                rare[words[k]] += 1
            out[0].append(len(words))
            out[1].append(int(stats.known[common].sum()) if index else 0)
            out[2].append(float(stats.base[common].sum()))
            out[3].append(float(stats.within[common].sum()))
            out[4].append(classes.astype("<u2").tobytes())
            out[5].append([{"word": w, "n": n} for w, n in rare.items()])
        cells = [batch.column("row_id"), batch.column("doc_id"), batch.column("held_out"), *out]
        yield arrow_batch(names, types, cells)


def flat_classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts).astype(np.int64), np.cumsum(lengths) - lengths, lengths


def baum_welch(coded: DataFrame, frequency: np.ndarray, states: int, rounds: int):
    """Fit on all learning rows; the driver gets one row per parameter and round."""
    from .hidden_markov import Hmm, expected_counts

    spark = coded.sparkSession
    model = Hmm.initial(frequency, states, SEED)
    learning = coded.where("NOT held_out").select("classes")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = None
            for batch in slices(batches, "classes", 1 << 20):
                flat, starts, lengths = flat_classes(batch.column("classes"))
                pieces = -(-lengths // WINDOW)
                rank = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(starts, pieces) + rank * WINDOW
                size = np.minimum(WINDOW, np.repeat(starts + lengths, pieces) - first)
                found, _ = expected_counts(shared.value, flat, first, size, rank == 0)
                counts = found if counts is None else counts + found
            if counts is not None:
                some = np.flatnonzero(counts > 1e-9)
                yield arrow_batch(["k", "x"], [pa.int64(), pa.float64()], [some, counts[some]])

        sums = learning.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(2 * states + states * states + states * len(frequency))
        for r in sums:
            counts[r.k] = r.x
        model = Hmm.from_counts(counts, frequency, states)
        shared.unpersist()
    return model


def scores(docs: DataFrame, learn: Column | None = None, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    learn = id_remainder(7) != 2 if learn is None else learn
    bodies = docs.select(text_bytes().alias("body"), learn.alias("learn"))
    words = bodies.mapInArrow(count_words, "word binary, c long, seen long")
    counts = staged(words.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()

    cut = frequency_cut(counts, frequent)
    is_frequent = (F.octet_length("word") == 0) | (F.col("seen") >= cut)
    common = [(bytes(r.word), r.c) for r in counts.where(is_frequent).collect()]
    own = [bytes(w) for w, c in sorted(common, key=lambda x: (x[0] != END, -x[1], x[0]))[:OWN] if c]
    known_words = counts.where("c > 0").drop("seen")
    in_hashed = known_words.where(~F.col("word").isin(own)) if own else known_words
    per_class = in_hashed.groupBy(class_of_rare().alias("k")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).collect()
    hashed = {r.k: (r.total, r.kinds) for r in per_class}
    stats = WordStatistics(common, totals.n, totals.v, hashed)
    shared = spark.sparkContext.broadcast(stats)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_texts(batches, shared.value)

    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (~learn).alias("held_out"),
        text_bytes().alias("body"),
    )
    coded = staged(read.mapInArrow(code, CODED), "coded")

    model = baum_welch(coded, stats.frequencies(common), states, rounds)
    shared_model = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .hidden_markov import log_likelihoods

        for batch in slices(batches, "classes", 8 << 20):
            flat, starts, lengths = flat_classes(batch.column("classes"))
            found = log_likelihoods(shared_model.value, flat, starts, lengths) / np.log(10)
            yield arrow_batch(["row_id", "hmm"], [pa.int64(), pa.float64()], [batch.column("row_id"), found])

    # Rare words: count, class total and kinds give both logarithms; an unknown word has the class's discounts.
    rare = coded.select("row_id", F.explode("rare").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    rows = [(k, float(t), float(v)) for k, (t, v) in hashed.items()]
    by_class = spark.createDataFrame(rows, "k long, total double, kinds double")
    known = rare.join(counts.where(~is_frequent & (F.col("c") > 0)).drop("seen"), "word", "left").withColumn("k", class_of_rare()).join(F.broadcast(by_class), "k", "left")
    left_over = F.coalesce(F.log10(F.col("kinds") * DISCOUNT / F.col("total")), F.lit(0.0))
    rare_sums = known.groupBy("row_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(totals.n + totals.v + 1)))).alias("rare_base"),
        F.sum(F.col("n") * F.coalesce(F.log10((F.col("c") - DISCOUNT) / F.col("total")), left_over)).alias("rare_within"),
    )
    likelihood = coded.select("row_id", "classes").mapInArrow(score, "row_id long, hmm double")
    parts = coded.drop("classes", "rare").join(likelihood, "row_id").join(rare_sums, "row_id", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    full = F.col("hmm") + F.col("within") + F.coalesce("rare_within", F.lit(0.0))
    return parts.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (full if totals.n else base).alias("score"),
    )
