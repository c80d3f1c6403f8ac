"""Personal data: base patterns, then spans that a semi-Markov conditional random field adds.

The base patterns find e-mail addresses, IP addresses, card numbers and telephone numbers, leftmost and
without overlap for each kind. They run in linear time: each starts only where a match can start.

The model labels windows of tokens around hints (long digit groups, written-out or broken-up addresses).
A segment of up to ``LONGEST`` tokens is scored as a whole, by features such as its digit groups, check
digit, separators and neighbours; a dynamic program over bounded segments chooses boundaries and kinds jointly, and a
segment is added if its posterior is at least ``SURE`` and it overlaps no base span. Long runs of hints are searched
in windows that reach ``OVERLAP`` tokens into their neighbours; each segment is taken from the window in whose own part
it starts. It learns from
windows of about ``SAMPLE_DOCS`` documents (those with the smallest hashes, twice that number at most), labelled by the base spans in them, and from
altered copies of these: plus signs dropped, dots for blanks, addresses written out, check digits broken.

A segment ends at its last token and beats another of the same span by its score; of equal scores the one listed first
in ``candidate_kinds`` wins. On altered forms in held-out documents the tests measure recall and precision, both over 0.9.

Defined results: a null text is empty; rows are judged each by their own text, repeated ones alike; without training
windows nothing is added; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 600
WINDOWS_PER_DOC = 4
LONGEST = 24
WINDOW, OVERLAP = 2000, 2 * LONGEST
SURE = 0.9
EPOCHS, SEED = 5, 3

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, sign in enumerate(reversed(digits)):
        x = int(sign) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(re.findall("[0-9]", text))


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free, "email"
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans by start, then kind."""
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
#: A run of at least nine digits in groups, and an address whose signs are written out or bracketed.
DIGIT_HINT = re.compile(r"(?<![0-9])[0-9](?:[ ().\[\]-]{0,3}[0-9]){8}")
AT_HINT = re.compile(r"(?:\(at\)|\[at\]| at |@)(?=[ A-Za-z0-9-]{1,64}(?:\(dot\)|\[dot\]| dot |\[\.\]))", re.I)
BROKEN_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")
AROUND = 48


def hints(text: str, longest: float = WINDOW) -> Iterator[tuple[int, int]]:
    """Windows that may hold personal data, by start, without overlap, at the edges of words."""
    marks = [m.span() for m in DIGIT_HINT.finditer(text)] + [m.span() for m in AT_HINT.finditer(text)] + [m.span() for m in BROKEN_IP.finditer(text)]
    last: tuple[int, int] | None = None
    for start, end in sorted(marks):
        low, high = max(0, start - AROUND), min(len(text), end + AROUND)
        while low and text[low - 1].isalnum() and start - low < 2 * AROUND:
            low -= 1
        while high < len(text) and text[high].isalnum() and high - end < 2 * AROUND:
            high += 1
        if last and low <= last[1] and high - last[0] < longest:
            last = last[0], max(last[1], high)
            continue
        if last:
            yield last
            low = max(low, last[1])
        last = low, high
    if last:
        yield last


def search_windows(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Windows of bounded size over all runs of hints, and the part of each whose segments are its own."""
    for low, high in hints(text, math.inf):
        tokens = [m.span() for m in TOKEN.finditer(text, low, high)]
        first = 0
        while first < len(tokens):
            last = first + 1
            while last < len(tokens) and tokens[last][1] - tokens[first][0] < WINDOW:
                last += 1
            reach = tokens[max(0, first - OVERLAP)][0], tokens[min(len(tokens), last + OVERLAP) - 1][1]
            yield *reach, tokens[first][0], tokens[last - 1][1]
            first = last


def shape(segment: str) -> str:
    """Lengths of digit groups with what stands between them, blanks and hyphens alike."""
    out = re.sub(r"[0-9]+", lambda m: str(len(m[0])), segment)
    return re.sub(r"[ -]", "-", re.sub(r"[A-Za-z]+", "a", out))[:40]


def token_kind(token: str) -> str:
    if not token:
        return "edge"
    return "digits" if token[0].isdigit() else "letters" if token[0].isalpha() else "blank" if token.isspace() else token


def candidate_kinds(segment: str, digits: str) -> list[str]:
    """Kinds whose form a segment can have at all; keeps the lattice sparse."""
    kinds = []
    if 12 <= len(digits) <= 19 and segment[0].isdigit() and segment[-1].isdigit() and not re.search("[A-Za-z]", segment):
        kinds.append("card")
    if 9 <= len(digits) <= 15 and segment[0] in "+(0123456789" and segment[-1].isdigit() and not re.search(r"[^0-9 ().+-]", segment):
        kinds.append("phone")
    if re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}", segment) and all(int(x) <= 255 for x in re.findall("[0-9]+", segment)):
        kinds.append("ip")
    if re.fullmatch(r"[\w.%+-]+(?:@| ?\(at\) ?| ?\[at\] ?| at )[\w-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot |\[\.\])[\w-]+)+", segment, re.I):
        kinds.append("email")
    return kinds


GOES_ON = re.compile(r"[ ]?(?:\(?\[?dot\b|\[\.|\(\.|[.@-]?[A-Za-z0-9])|[ ]?[.-]?[0-9]", re.I)
COMES_FROM = re.compile(r"[A-Za-z0-9][._%+-]?$|[0-9][ .-]?$")


def features(kind: str, segment: str, digits: str, left: str, right: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate segment, its neighbour tokens, and whether it seems cut out of a longer one."""
    goes_on = bool(GOES_ON.match(after)) if kind != "email" else bool(re.match(r" ?[(\[]?dot\b|\.?\[?\.?\]?[A-Za-z0-9]", after, re.I))
    ends = segment.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]
    found = ["bias", f"n={len(digits)}", f"left={token_kind(left)}", f"right={token_kind(right)}"]
    found += [f"on={goes_on}", f"from={bool(COMES_FROM.search(before))}"]
    if kind == "card":
        found += [f"luhn={luhn(digits)}", f"first={digits[:1]}", f"shape={shape(segment)}"]
    elif kind == "phone":
        found += [f"plus={segment[0] == '+'}", f"bracket={'(' in segment and ')' in segment}", f"balanced={segment.count('(') == segment.count(')')}"]
        found += [f"groups={len(re.findall('[0-9]+', segment))}", f"doubled={bool(re.search('[ .-]{2}', segment))}", f"luhn={len(digits) > 11 and luhn(digits)}"]
    elif kind == "ip":
        found += [f"sign={re.sub('[0-9]', '', segment)[:3]}"]
    else:
        found += [f"at={bool(re.search('@', segment))}", f"suffix={min(len(ends), 5)}", f"dots={min(3, len(re.findall(r'[.]|dot', segment)))}"]
    return [f"{kind}:{f}" for f in found]


class Lattice:
    """All candidate segments of a window; features also see the text around it."""

    def __init__(self, window: str, before: str = "", after: str = ""):
        self.window = window
        self.tokens = [(m.start(), m.end()) for m in TOKEN.finditer(window)]
        self.segments: list[tuple[int, int, str, list[str]]] = []
        outer_left, outer_right = (TOKEN.findall(before) or [""])[-1], (TOKEN.findall(after) or [""])[0]
        for i, (start, _) in enumerate(self.tokens):
            if window[start].isspace() or not (window[start].isalnum() or window[start] in "+("):
                continue
            for j in range(i, min(len(self.tokens), i + LONGEST)):
                segment = window[start : self.tokens[j][1]]
                if not segment[-1].isalnum() or j - i < 2 and len(segment) < 9:
                    continue
                digits = digits_of(segment)
                for kind in candidate_kinds(segment, digits):
                    left = window[slice(*self.tokens[i - 1])] if i else outer_left
                    right = window[slice(*self.tokens[j + 1])] if j + 1 < len(self.tokens) else outer_right
                    end = self.tokens[j][1]
                    came = (before[-3:] + window[max(0, start - 3) : start])[-3:] if start < 3 else window[start - 3 : start]
                    follows = (window[end : end + 8] + after)[:8]
                    self.segments.append((i, j + 1, kind, features(kind, segment, digits, left, right, came, follows)))

    def marginals(self, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, float]:
        """Scores and posteriors of the segments, and the log partition; tokens outside segments score 0."""
        n = len(self.tokens)
        scores = np.array([sum(map(weights.__getitem__, f)) for *_, f in self.segments] or [0.0])
        ending: dict[int, list[int]] = defaultdict(list)
        starting: dict[int, list[int]] = defaultdict(list)
        for k, (i, j, _, _) in enumerate(self.segments):
            ending[j].append(k)
            starting[i].append(k)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            forward[t] = log_sum([forward[t - 1], *(forward[self.segments[k][0]] + scores[k] for k in ending[t])])
        for t in range(n - 1, -1, -1):
            backward[t] = log_sum([backward[t + 1], *(backward[self.segments[k][1]] + scores[k] for k in starting[t])])
        sure = [math.exp(min(0.0, forward[i] + scores[k] + backward[j] - forward[n])) for k, (i, j, _, _) in enumerate(self.segments)]
        return scores, np.array(sure), forward[n]

    def best(self, weights: dict[str, float]) -> Iterator[tuple[int, int, str, float]]:
        """Segments of the best labelling, as character places in the window, with posteriors."""
        scores, sure, _ = self.marginals(weights)
        n = len(self.tokens)
        ending: dict[int, list[int]] = defaultdict(list)
        for k, (_, j, _, _) in enumerate(self.segments):
            ending[j].append(k)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for k in ending[t]:
                if (v := value[self.segments[k][0]] + scores[k]) > value[t]:
                    value[t], back[t] = v, k
        t = n
        while t:
            if back[t] < 0:
                t -= 1
                continue
            i, j, kind, _ = self.segments[back[t]]
            yield self.tokens[i][0], self.tokens[j - 1][1], kind, float(sure[back[t]])
            t = i


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


Labelled = tuple[str, list[Span]]


def training_windows(text: str) -> list[Labelled]:
    """Windows around base spans and around hints, with the base spans inside as labels."""
    spans = base_spans(text)
    places = [(max(0, s - AROUND), min(len(text), e + AROUND)) for s, e, _ in spans] + list(hints(text))
    out = []
    for low, high in places[:WINDOWS_PER_DOC]:
        inside = [(s - low, e - low, k) for s, e, k in spans if low <= s and e <= high]
        cut = [s for s, e, _ in spans if s < high and e > low and not (low <= s and e <= high)]
        if not cut:
            out.append((text[low:high], inside))
    return out


def altered(window: str, spans: list[Span], rng: random.Random) -> Labelled | None:
    """The window with its only span rewritten, with the label that the new form deserves."""
    if len(spans) != 1:
        return None
    start, end, kind = spans[0]
    old = window[start:end]
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", "[.]")])
        local, domain = old.split("@")
        new = local + at + domain.replace(".", dot)
    elif kind == "ip":
        new = old.replace(".", rng.choice(["[.]", "(.)", "[.]"]))
    elif kind == "phone":
        new = old[1:] if re.search(r"[ ().-]", old) else ""
    else:
        digits = digits_of(old)
        if rng.random() < 0.5:
            new, kind = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10), ""
        else:
            new = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if not new:
        return None
    made = [(start, start + len(new), kind)] if kind else []
    return window[:start] + new + window[end:], made


def train(windows: list[Labelled], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood, with adaptive steps."""
    rng = random.Random(SEED)
    examples = []
    for window, spans in windows:
        for text, labels in filter(None, ((window, spans), altered(window, spans, rng))):
            lattice = Lattice(text)
            wanted = {(s, e, k) for s, e, k in labels}
            gold = np.array([(lattice.tokens[i][0], lattice.tokens[j - 1][1], k) in wanted for i, j, k, _ in lattice.segments])
            if len(gold):
                examples.append((lattice, gold))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-2)
    for _ in range(epochs):
        rng.shuffle(examples)
        for lattice, gold in examples:
            _, sure, _ = lattice.marginals(weights)
            for (*_, names), wanted, p in zip(lattice.segments, gold, sure, strict=True):
                step = float(wanted) - p
                if abs(step) < 1e-3:
                    continue
                for name in names:
                    gradient = step - 1e-3 * weights[name]
                    squares[name] += gradient * gradient
                    weights[name] += 0.3 * gradient / math.sqrt(squares[name])
    return dict(weights)


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    known = defaultdict(float, weights)
    out = []
    free = 0
    for low, high, own_low, own_high in search_windows(text):
        inside = [(s, e) for s, e, _ in base if s < high and e > low]
        lattice = Lattice(text[low:high], text[max(0, low - 8) : low], text[high : high + 8])
        for start, end, kind, sure in sorted(lattice.best(known)):
            s, e = low + start, low + end
            if not own_low <= s < own_high or s < free:
                continue
            if sure >= SURE and not any(s < y and x < e for x, y in inside) and (kind != "card" or luhn(digits_of(text[s:e]))):
                out.append((s, e, kind))
                free = e
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [(w, listed(spans)) for t in batch.column("text").to_pylist() for w, spans in training_windows(t)]
        if rows:
            yield arrow_batch(["w", "spans"], [pa.string(), pa.string()], list(zip(*rows, strict=True)))


def fit(docs: DataFrame, size: int = SAMPLE_DOCS) -> dict[str, float]:
    """Weights from a bounded sample of the documents that have a digit or an at sign."""
    likely = docs.where(F.col("text").rlike(r"@|[0-9]{3}"))
    n = likely.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)).cast("double") / (1 << 30)
    drawn_rows = likely.select("text", drawn.alias("drawn"), F.xxhash64("text").alias("key")).where(F.col("drawn") < (size / n if n else 0.0))
    chosen = drawn_rows.orderBy("drawn", "key").limit(2 * size).select("text")
    rows = chosen.mapInArrow(window_rows, "w string, spans string").orderBy("w", "spans").collect()
    windows = []
    for r in rows:
        parts = [x.split(":") for x in r.spans.split(",") if x]
        windows.append((r.w, [(int(s), int(e), k) for k, s, e in parts]))
    return train(windows)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, size: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``; the counts are those of the base spans, ``spans`` has all."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, size))
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, weights) if weights else []
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                counts = [sum(k == kind for *_, k in base) for kind in KINDS]
                cells = [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(more)]
                for column, value in zip(out, cells, strict=True):
                    column.append(value)
            yield arrow_batch(names, types, [batch.column("doc_id"), *out])

    read: Column = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), read.alias("text")).mapInArrow(run, FOUND)
