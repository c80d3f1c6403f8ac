"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of non-letters is one boundary. Each learned language has a model of
order ``ORDER``: raw counts at the top, continuation counts below, one discount per order, interpolated
down to a uniform floor. The n-grams of all languages stand in one sorted hash array per order, with one column of
log probabilities for each language; a second array per order has the weights that unseen n-grams
pass down. A text's entropy is exact under each model: its n-grams are looked up whole, and those not found fall
back order by order. The language with the lowest entropy per character wins; ties go to the first name.

The fit takes about ``SAMPLE_DOCS`` labelled documents of each language, those with the smallest hashes
of doc_id, one in five of them for calibration only: the share is set from the count of labelled rows per language, and
at most twice that number is used. Calibration documents are measured whole and in pieces of every length class
(powers of two). A document is rejected when its entropy exceeds the median of the predicted language in
its length class by more than three times what the 99th percentile there does, and by ``FLOOR`` nats at least.
Where a language has fewer than ``LEAST`` pieces of a class, the excess of all languages' pieces counts too; a
language without calibration is held against the highest median. Nothing is rejected for its entropy where no
language was calibrated.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; without any training row, all
others are ``und`` too; null labels are not learned; texts are scored whole, those over ``PART`` characters part by part; the fit
holds the n-grams of each distinct label's sample on the driver; repeated rows are predicted alike; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, id_remainder, slices

SLICE = 1 << 20
#: Characters of a longer text that are scored at once.
PART = 1 << 20

ORDER = 4
SAMPLE_DOCS = 400
FLOOR = 0.25
#: Length classes end at powers of two; pieces per document and class; pieces that calibrate a class.
SHORTEST, LONGEST = 2, 10
PIECES, LEAST = 4, 50
UNDECIDED = "und"
SPREAD = 2.0
GOLD = np.uint64(0x9E3779B97F4A7C15)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool))
    return _LETTERS[0]


def folded(codes: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A 16-bit symbol for each letter, 0 for all else."""
    return np.where(keep, np.maximum(((codes >> 16) * 31 ^ codes) & 0xFFFF, 1), 0).astype(np.uint64)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of 16-bit symbols; where boundaries were put in; first places; letters per text.

    A text follows ``ORDER - 1`` boundaries, so no context reaches into its neighbour. Inside it, letters are kept and
    the non-letters after a letter become one 0. Letters beyond 16 bits are folded onto them.
    """
    gap = "\n" * (ORDER - 1)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(gap.join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[codes]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    first = np.cumsum(lengths + len(gap)) - lengths
    between = np.zeros(len(codes), bool)
    for back in range(1, len(gap) + 1):
        between[np.append(first, len(codes)) - back] = True
    n_letters = np.add.reduceat(keep, first, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    kept = keep | between | np.append(False, keep[:-1])
    before = np.cumsum(kept) - kept
    return folded(codes, keep)[kept], between[kept], before[first], n_letters


def packed(stream: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n-gram that ends at each place."""
    key = np.zeros(len(places), np.uint64)
    for back in range(n):
        key |= stream[np.maximum(places - back, 0)] << np.uint64(16 * back)
    return key * GOLD


def gram_key(gram: tuple[int, ...]) -> np.uint64:
    value = 0
    for back, sign in enumerate(reversed(gram)):
        value |= sign << (16 * back)
    return np.uint64(value * int(GOLD) & 0xFFFFFFFFFFFFFFFF)


@dataclass
class Table:
    """Sorted hashes with a row of one number per language."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, rows: dict[tuple[int, ...], list[float]], width: int) -> Table:
        keys = np.array([gram_key(g) for g in rows], np.uint64)
        order = np.argsort(keys)
        values = np.array(list(rows.values()), np.float32).reshape(len(rows), width)
        return cls(keys[order], values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys


class KneserNey:
    """One language: probabilities of symbols after contexts, from the counts of its highest order."""

    def __init__(self, counts: dict[tuple[int, ...], int], order: int, alphabet: int):
        self.floor = 1.0 / alphabet
        self.levels: dict[int, tuple] = {}
        for n in range(order, 0, -1):
            totals, kinds, once, twice = defaultdict(int), defaultdict(int), 0, 0
            for gram, c in counts.items():
                totals[gram[:-1]] += c
                kinds[gram[:-1]] += 1
                once += c == 1
                twice += c == 2
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            self.levels[n] = dict(counts), totals, kinds, discount
            counts = Counter(gram[1:] for gram in counts)

    def passed(self, n: int, context: tuple[int, ...]) -> float:
        """What order ``n`` passes down after a context."""
        _, totals, kinds, discount = self.levels[n]
        return discount * kinds[context] / totals[context] if context in totals else 1.0

    def probability(self, n: int, gram: tuple[int, ...], lower: float) -> float:
        counts, totals, _, discount = self.levels[n]
        seen = max(counts.get(gram, 0) - discount, 0) / totals[gram[:-1]] if gram[:-1] in totals else 0.0
        return seen + self.passed(n, gram[:-1]) * lower


@dataclass
class LanguageModels:
    names: list[str]
    order: int = ORDER
    grams: dict[int, Table] = field(default_factory=dict)
    weights: dict[int, Table] = field(default_factory=dict)
    floor: float = 0.0
    #: For each language, the highest entropy that is kept in each length class.
    limits: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, counts: dict[str, dict[tuple[int, ...], int]], order: int = ORDER) -> LanguageModels:
        names = sorted(counts)
        signs = {gram[-1] for grams in counts.values() for gram in grams}
        models = [KneserNey(counts[name], order, len(signs) + 1) for name in names]
        made = cls(names, order, floor=float(np.log(1.0 / (len(signs) + 1))))
        below: dict[tuple[int, ...], list[float]] = {(): [m.floor for m in models]}
        for n in range(1, order + 1):
            here = {}
            for gram in {g for m in models for g in m.levels[n][0]}:
                low = below.get(gram[1:]) if n > 1 else below[()]
                here[gram] = [m.probability(n, gram, p) for m, p in zip(models, low, strict=True)]
            contexts = {c for m in models for c in m.levels[n][1]}
            made.grams[n] = Table.of({g: np.log(p).tolist() for g, p in here.items()}, len(names))
            made.weights[n] = Table.of({c: [float(np.log(m.passed(n, c))) for m in models] for c in contexts}, len(names))
            below = here
        return made

    def _scores(self, stream: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Log probability of the symbol at each place, after its context, under every language."""
        if not n:
            return np.full((len(places), len(self.names)), self.floor, np.float32)
        keys = packed(stream, places, n)
        at, found = self.grams[n].find(keys)
        out = self.grams[n].rows[at] if len(self.grams[n].keys) else np.zeros((len(places), len(self.names)), np.float32)
        missing = np.flatnonzero(~found)
        if len(missing):
            context = packed(stream, places[missing] - 1, n - 1)
            at, known = self.weights[n].find(context)
            passed = np.where(known[:, None], self.weights[n].rows[at], 0) if len(self.weights[n].keys) else 0
            out[missing] = passed + self._scores(stream, places[missing], n - 1)
        return out

    def long_entropy(self, text: str) -> tuple[np.ndarray, int, int]:
        """Nats per symbol, symbols and letters of a text that is read in parts; each goes on where the last one ends."""
        known, total = letters(), np.zeros(len(self.names))
        tail, after_letter, n, n_letters = np.zeros(ORDER - 1, np.uint64), False, 0, 0
        for start in range(0, len(text), PART):
            codes = np.frombuffer(text[start : start + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            keep = known[codes]
            kept = keep | np.append(after_letter, keep[:-1])
            stream = np.concatenate([tail, folded(codes, keep)[kept]])
            total += self._scores(stream, np.arange(len(tail), len(stream)), self.order).sum(axis=0, dtype=np.float64)
            n += int(kept.sum())
            n_letters += int(keep.sum())
            tail, after_letter = stream[-(ORDER - 1) :], bool(keep[-1])
        return -total / max(n, 1), max(n, 1), n_letters

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol under every language, symbols, and letters of each text."""
        long = {k for k, t in enumerate(texts) if len(t) > PART}
        if long:
            rest = self.entropies([t for k, t in enumerate(texts) if k not in long])
            others = iter(zip(*rest, strict=True))
            rows = [self.long_entropy(t) if k in long else next(others) for k, t in enumerate(texts)]
            return tuple(np.array(c) for c in zip(*rows, strict=True))
        stream, between, first, n_letters = symbols(texts)
        scores = self._scores(stream, np.arange(len(stream)), self.order)
        scores[between] = 0
        totals = np.add.reduceat(scores, first, axis=0, dtype=np.float64) if len(first) else scores[:0]
        n = np.maximum(np.diff(np.append(first, len(stream))) - (ORDER - 1), 1)
        return -totals / n[:, None], n, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, entropy and rejection of each text."""
        entropies, n, n_letters = self.entropies(texts)
        best = entropies.argmin(axis=1)
        least = entropies[np.arange(len(texts)), best]
        gap = (entropies - least[:, None]) * np.minimum(n, 50)[:, None] / SPREAD
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        names, scores, rejected = [], [], []
        for k, h, s, length, some in zip(best.tolist(), least.tolist(), score.tolist(), n.tolist(), n_letters.tolist(), strict=True):
            if not some:
                names.append(UNDECIDED)
                scores.append(0.0)
                rejected.append(True)
                continue
            names.append(self.names[k])
            scores.append(s)
            rejected.append(bool(self.names[k] in self.limits and h > self.limits[self.names[k]][length_class(length)]))
        return names, scores, least.tolist(), rejected


def length_class(n: int) -> int:
    return min(max(n.bit_length() - 1, SHORTEST), LONGEST) - SHORTEST


def pieces(text: str) -> list[str]:
    """The text, and up to ``PIECES`` pieces for each shorter length class, from the beginnings of words."""
    out = [text]
    for power in range(SHORTEST, LONGEST + 1):
        size = 3 << power - 1
        for part in range(PIECES if len(text) > size else 0):
            at = text.find(" ", (len(text) - size) * part // PIECES) + 1 if part else 0
            out.append(text[at : at + size])
    return out


def limits(names: list[str], measured: list[tuple[str, int, float]]) -> dict[str, np.ndarray]:
    """Highest kept entropy by language and length class, from (language, symbols, entropy) of calibration pieces."""
    seen: dict[tuple[str, int], list[float]] = defaultdict(list)
    for lang, n, h in measured:
        seen[lang, length_class(n)].append(h)
    out = {name: np.full(LONGEST - SHORTEST + 1, np.inf) for name in names}
    for c in range(LONGEST - SHORTEST + 1):
        usual = {lang: float(np.median(seen[lang, c])) for lang in names if (lang, c) in seen}
        excess = {lang: np.array(seen[lang, c]) - u for lang, u in usual.items()}
        if not usual:
            continue
        pooled = float(np.quantile(np.concatenate(list(excess.values())), 0.99))
        for lang in names:
            own = float(np.quantile(excess[lang], 0.99)) if lang in excess else 0.0
            some = own if lang in excess and len(excess[lang]) >= LEAST else max(own, pooled)
            out[lang][c] = usual.get(lang, max(usual.values())) + max(FLOOR, 3 * some)
    return out


def labelled_sample(docs: DataFrame, learn: Column, size: int) -> DataFrame:
    """About ``size`` rows of each language (twice that at most): lang, text, calibration."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return known.select("lang", "text", F.lit(False).alias("calibration")).limit(0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, size / n))])
    chosen = known.select("lang", "text", drawn.alias("drawn")).where(F.col("drawn") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", F.xxhash64("text")))
    ranked = chosen.withColumn("rank", rank).where(F.col("rank") <= 2 * size)
    return ranked.select("lang", "text", (F.col("rank") % 5 == 0).alias("calibration"))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the highest order in each slice, by language."""
    names, types = ["lang", "gram", "c"], [pa.string(), pa.int64(), pa.int64()]
    undo = np.uint64(pow(int(GOLD), -1, 1 << 64))
    for batch in slices(batches, "text", SLICE):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in sorted(set(langs)):
            stream, between, _, _ = symbols(texts[langs == lang].tolist())
            keys = packed(stream, np.flatnonzero(~between), ORDER) * undo
            grams, counts = np.unique(keys, return_counts=True)
            yield arrow_batch(names, types, [[lang] * len(grams), grams.view(np.int64), counts])


def fit_languages(docs: DataFrame, learn: Column, size: int = SAMPLE_DOCS) -> LanguageModels | None:
    sample = labelled_sample(docs, learn, size)
    grams = sample.where("NOT calibration").select("lang", "text").mapInArrow(gram_counts, "lang string, gram long, c long")
    counts: dict[str, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lang, gram, c in grams.groupBy("lang", "gram").agg(F.sum("c").alias("c")).collect():
        value = gram & 0xFFFFFFFFFFFFFFFF
        counts[lang][tuple(value >> 16 * back & 0xFFFF for back in range(ORDER - 1, -1, -1))] = c
    if not counts:
        return None
    models = LanguageModels.fit(counts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", SLICE):
            cut = [(x, p) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in pieces(t)]
            langs = [x for x, _ in cut]
            entropies, n, n_letters = model.entropies([p for _, p in cut])
            rows = [(x, float(h[model.names.index(x)]), int(k)) for x, h, k, some in zip(langs, entropies, n, n_letters, strict=True) if some and x in model.names]
            if rows:
                yield arrow_batch(["lang", "h", "n"], [pa.string(), pa.float64(), pa.int64()], list(zip(*rows, strict=True)))

    found = sample.where("calibration").select("lang", "text").mapInArrow(measure, "lang string, h double, n long").collect()
    models.limits = limits(models.names, [(r.lang, r.n, r.h) for r in found])
    return models


DECISION = "lang_pred string, score double, entropy double, rejected boolean"


def decided(docs: DataFrame, learn: Column | None = None, size: int = SAMPLE_DOCS) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, with held_out, lang_pred, score, entropy and rejected."""
    learn = id_remainder(4) != 2 if learn is None else learn
    models = fit_languages(docs, learn, size)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc", "held_out", *[f.split()[0] for f in DECISION.split(", ")]]
    types = [None, None, pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), (~learn).alias("held_out"))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column("doc").field("text")
        for part in slices(iter([pa.RecordBatch.from_arrays([*batch.columns, text], ["doc", "held_out", "text"])]), "text", SLICE):
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in parts(batch) if batch.num_rows else ():
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = len(texts)
                found = model.predict(texts) if model else ([UNDECIDED] * n, [0.0] * n, [None] * n, [True] * n)
                yield arrow_batch(names, types, [part.column("doc"), part.column("held_out"), *found])

    return read.mapInArrow(run, T.StructType(read.schema.fields + T._parse_datatype_string(DECISION).fields))


def identify(docs: DataFrame, learn: Column | None = None, size: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, entropy, rejected."""
    found = decided(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), learn, size)
    return found.select("doc.doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known; what is rejected goes."""
    return decided(docs).where("NOT rejected").select("doc.*")
