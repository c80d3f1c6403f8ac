import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import bench_words, contamination as brute_contamination
from poolwise.llm import pii
from poolwise.llm.chat import HEADINGS, format_chat, read_chat
from poolwise.llm.decontaminate import contamination, hits, item_blocks, without_contaminated, without_spans
from poolwise.llm.hidden_markov import Hmm, expected_counts, log_likelihoods, unpack
from poolwise.llm.language_id import UNDECIDED, LanguageModels, fit_languages, identified, identify, length_class, limits
from poolwise.llm.lm_score import scores
from poolwise.llm.url_filter import RULES, judge


# Decontamination


def test_contamination_equals_brute_force(spark, sample):
    docs, texts = sample
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    for r in contamination(docs, benchmark).collect():
        hit, found = brute_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (len(bench_words(texts[r.doc_id])), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_contamination_by_blocks_and_on_odd_rows(spark, make_docs):
    ten = "one two three four five six seven eight nine ten"
    items = {1: ten + " eleven", 2: "Zürich, 42!", 3: "", 4: None, 5: ten, 11: "zürich 42", 6: "..."}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [(1, f"x {ten.upper()}! ELEVEN y"), (2, "zürich--42 zürich"), (3, None), (4, ""), (4, ten), (None, "clean text"), (7, "w " * 50_000 + ten)]
    frame = make_docs(docs)
    for limit in (1 << 20, 60):
        rows = hits(frame, benchmark, block_chars=limit).collect()
        assert len(rows) == len(docs)
        for r in rows:
            hit, found = brute_contamination(r.doc.text, items)
            assert (set(r.hit_words), set(r["items"])) == (hit, found)
    assert len(list(item_blocks(benchmark, 60))) > 1
    assert without_contaminated(frame, benchmark).columns == frame.columns
    assert sorted(r.doc_id or 0 for r in without_contaminated(frame, benchmark).collect()) == [0, 3, 4]
    cut = {r.doc_id: r.text for r in without_spans(frame, benchmark).collect()}
    assert cut[1] == "x y" and cut[2] == "zürich"
    assert hits(frame, benchmark.limit(0)).where("size(hit_words) > 0").count() == 0
    assert contamination(make_docs([]), benchmark).count() == 0


# Language


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 2


def test_language_probabilities_sum_to_one():
    rng = random.Random(7)
    counts = {"x": Counter(), "y": Counter()}
    for name, letters in (("x", (5, 6, 7)), ("y", (7, 8))):
        stream = [0, 0, 0] + [rng.choice((0, *letters)) for _ in range(400)]
        for i in range(3, len(stream)):
            counts[name][tuple(stream[i - 3 : i + 1])] += 1
    models = LanguageModels.fit(counts)
    for context in ([0, 0, 0], [5, 6, 5], [8, 8, 8], [5, 8, 5]):
        total = np.zeros(2)
        for sign in (0, 5, 6, 7, 8, 99):
            stream = np.array([*context, sign], np.uint64)
            total += np.exp(models._scores(stream, np.array([3]), 4)[0])
        assert total == pytest.approx([1, 1], abs=1e-4)


def plain_entropy(counts, text):
    """Interpolated Kneser-Ney from the counts of four-symbol windows, written as its recursion; nats per symbol."""
    signs = {g[-1] for grams in counts.values() for g in grams}

    def order(grams):
        """Counts of each order, the lower ones of distinct left neighbours."""
        found = {4: dict(grams)}
        for n in (3, 2, 1):
            found[n] = Counter(g[1:] for g in found[n + 1])
        return found

    def probability(levels, context, sign):
        if len(context) < 0 or not levels:
            return 1 / (len(signs) + 1)
        n = max(levels)
        lower = probability({k: v for k, v in levels.items() if k < n}, context[1:], sign)
        table = levels[n]
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        after = {g[-1]: c for g, c in table.items() if g[:-1] == context}
        if not after:
            return lower
        total = sum(after.values())
        return (max(after.get(sign, 0) - d, 0) + d * len(after) * lower) / total

    stream = []
    for ch in text.lower():
        if ch.isalpha():
            stream.append(max(((ord(ch) >> 16) * 31 ^ ord(ch)) & 0xFFFF, 1))
        elif stream and stream[-1]:
            stream.append(0)
    padded = [0, 0, 0, *stream]
    return {
        lang: -sum(math.log(probability(order(grams), tuple(padded[i : i + 3]), padded[i + 3])) for i in range(len(stream))) / max(len(stream), 1)
        for lang, grams in counts.items()
    }


def test_entropies_equal_a_plain_kneser_ney():
    taught = {"x": ["The cat sat on the mat.", "A cat, that is all; the hat!"], "y": ["der Hut ist alt", "das ist der Kater Ä", "𝔄 und ß"]}
    counts = {}
    for lang, texts in taught.items():
        grams = counts.setdefault(lang, Counter())
        for text in texts:
            stream = [0, 0, 0]
            for ch in text.lower():
                if ch.isalpha():
                    stream.append(max(((ord(ch) >> 16) * 31 ^ ord(ch)) & 0xFFFF, 1))
                elif len(stream) > 3 and stream[-1]:
                    stream.append(0)
            grams.update(tuple(stream[i - 3 : i + 1]) for i in range(3, len(stream)))
    models = LanguageModels.fit(counts)
    texts = ["the cat", "der Kater ist", "zzz qq", "a", "  hat -- 42 mat", "𝔄ß", "cat der that und " * 3]
    found, n, _ = models.entropies(texts)
    for row, text in zip(found, texts, strict=True):
        wanted = plain_entropy(counts, text)
        assert row == pytest.approx([wanted[name] for name in models.names], rel=1e-5), text
    assert models.predict(texts)[0] == [min(sorted(w), key=w.get) for w in (plain_entropy(counts, t) for t in texts)]


@pytest.mark.parametrize("unlearned", ["de", "es"])
def test_language_that_no_row_is_labelled_with_is_rejected(spark, unlearned):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    label = F.when(F.col("lang") != unlearned, F.col("lang"))
    rows = identify(docs.withColumn("lang", label)).collect()
    foreign = [r.rejected for r in rows if langs[r.doc_id] == unlearned]
    clean = [r.rejected for r in rows if langs[r.doc_id] != unlearned]
    assert sum(foreign) / len(foreign) > 0.9
    assert sum(clean) / len(clean) < 0.01


def test_limits_of_languages_with_few_or_no_calibration_pieces():
    measured = [("a", 100, 1 + k / 1000) for k in range(200)] + [("b", 100, 1.5)]
    found = {name: x[length_class(100)] for name, x in limits(["a", "b", "c"], measured).items()}
    assert found["a"] < found["b"] == found["c"] < 1.9
    assert np.isinf(limits(["a", "b"], measured)["a"][length_class(2000)]) and np.isinf(limits(["a"], [])["a"]).all()


def test_language_on_odd_rows(spark, make_docs, sample):
    docs, _ = sample
    models = fit_languages(docs, docs.doc_id >= 0)
    texts = ["der die das und nicht", "", "123 !?", "qqqq xkcd zzzz" * 20, "Ж" * 30]
    alone = [models.predict([t])[0][0] for t in texts]
    assert models.predict(texts)[0] == alone and alone[1] == alone[2] == UNDECIDED
    assert models.predict(["Ж" * 300])[3] == [True]
    odd = make_docs([(1, None), (2, "the of and"), (2, "the of and"), (None, "x" * 100_000), (5, "42")])
    rows = identify(odd).collect()
    assert len(rows) == 5 and {r.lang_pred for r in rows if r.doc_id in (1, 5)} == {UNDECIDED}
    assert identified(odd).columns == odd.columns
    assert identify(make_docs([])).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {UNDECIDED}


# Language-model scores


def test_forward_recursion_and_counts_equal_enumeration():
    rng = np.random.default_rng(8)
    model = Hmm(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random(3), rng.random((3, 3)))), None)
    emit = rng.random((4, 3))
    model.emit = emit / emit.sum(axis=0)
    seqs = [[0, 1, 3], [2], [3, 3, 0, 1, 1], [1, 2]]
    flat = np.array(sum(seqs, []))
    lengths = np.array(list(map(len, seqs)))
    starts = np.cumsum(lengths) - lengths

    def paths(seq):
        from itertools import product

        for z in product(range(3), repeat=len(seq)):
            p = model.start[z[0]] * model.emit[seq[0], z[0]]
            for t in range(1, len(seq)):
                p *= model.move[z[t - 1], z[t]] * model.emit[seq[t], z[t]]
            yield z, p

    totals = [sum(p for _, p in paths(s)) for s in seqs]
    assert log_likelihoods(model, flat, starts, lengths) == pytest.approx(np.log(totals))
    counts, likelihood = expected_counts(model, flat, starts, lengths, np.ones(4, bool))
    assert likelihood == pytest.approx(np.log(totals).sum(), rel=1e-5)
    start, inner, move, emitted = unpack(counts, 3)
    wanted_move, wanted_emit, wanted_start = np.zeros((3, 3)), np.zeros((4, 3)), np.zeros(3)
    for seq, total in zip(seqs, totals, strict=True):
        for z, p in paths(seq):
            wanted_start[z[0]] += p / total
            for t, state in enumerate(z):
                wanted_emit[seq[t], state] += p / total
                if t:
                    wanted_move[z[t - 1], state] += p / total
    assert start == pytest.approx(wanted_start, rel=1e-4) and not inner.any()
    assert move == pytest.approx(wanted_move, rel=1e-4) and emitted == pytest.approx(wanted_emit, rel=1e-4)


@pytest.mark.parametrize("frequent", [200_000, 50])
def test_base_scores_equal_brute_force(sample, frequent):
    docs, texts = sample
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in scores(docs, rounds=2, frequent=frequent).collect()}
    for i, ws in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_scores_do_not_depend_on_what_counts_as_frequent(sample):
    docs, _ = sample
    found = [{r.doc_id: r.score for r in scores(docs, rounds=1, frequent=k).collect()} for k in (200_000, 3000)]
    assert found[0] == pytest.approx(found[1], rel=1e-6)


def test_scores_on_odd_rows(make_docs):
    rows = scores(make_docs([(1, None), (2, ""), (2, "a b a"), (None, "c"), (5, "x " * 40_000)]), rounds=1).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 4, 40_001] and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert scores(make_docs([]), rounds=1).count() == 0
    only_held = make_docs([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert all(r.score == r.base_score and r.train_tokens == 0 for r in scores(only_held, rounds=1).collect())


def test_long_lines_and_unknown_words_of_a_third_of_the_rows_are_not_hot(make_docs, monkeypatch):
    from poolwise.llm import lm_score

    line = "https://example.org/" + "ab" * 300
    texts = {i: f"w{i} v{i % 37} w{i}" + (f" {line}" if i % 3 == 0 else "") for i in range(400)}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    texts |= {i: texts[i] + " neverlearned" for i in held}
    kept = {}
    real = lm_score.staged
    monkeypatch.setattr(lm_score, "staged", lambda df, name: kept.setdefault(name, real(df, name)))
    rows = {r.doc_id: r for r in scores(make_docs(list(texts.items())), rounds=1, frequent=60).collect()}
    shuffled = Counter(bytes(x.word) for r in kept["coded"].collect() for x in r.rare)
    assert shuffled and max(shuffled.values()) <= 2 * sum(len(t.split()) + 1 for t in texts.values()) / 60
    assert b"neverlearned" not in shuffled and max(map(len, shuffled)) <= lm_score.LONGEST_WORD
    counts = Counter(w for i, t in texts.items() if i not in held for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*t.split(), ""]
        assert rows[i].n_known == sum(counts[w] > 0 for w in words)
        assert rows[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    whole = {r.doc_id: r.score for r in scores(make_docs(list(texts.items())), rounds=1).collect()}
    assert all(math.isfinite(s) for s in whole.values())


# Personal data


def brute_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns(sample):
    rng = random.Random(9)
    parts = ["a.b", "@", "x", ".", "-", " ", "+", "12", "4785380592391139", "255", "256", "(523)", "555-1055", "1", "é", "%", "007", ".."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + list(sample[1].values())
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_take_linear_time():
    began = time.process_time()
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 300_000, "1 " * 100_000):
        pii.base_spans(text)
    assert time.process_time() - began < 10


def test_personal_data_keeps_base_spans_and_spares_clean_texts(make_docs, sample):
    pairs = [(1, None), (2, "mail a.b@c.de or 10.0.0.1"), (2, ""), (None, "+1 (523) 555-1055"), (4, "nothing here at all"), (5, "1 " * 20_000)]
    rows = pii.find_personal_data(make_docs(pairs)).collect()
    assert sorted((r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows)[-2:] == [(0, 0, 0, 1), (1, 1, 0, 0)]
    assert pii.find_personal_data(make_docs([])).count() == 0
    docs, texts = sample
    for r in pii.find_personal_data(docs).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(pii.listed(base).split(",")) <= set(r.spans.split(","))
        if not re.search(r"[0-9]{3}|@", texts[r.doc_id]):
            assert r.spans == ""


def test_segment_model_learns_altered_forms():
    rng = random.Random(10)
    windows = []
    for k in range(150):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"bob.lee{k}@mail{k % 9}.example.com"
        for span, kind in ((phone, "phone"), (mail, "email")):
            windows.append((f"on the {span} ingha for", [(7, 7 + len(span), kind)]))
        windows.append((f"in order {rng.randint(10**11, 10**12)} of them", []))
    weights = pii.train(windows)
    for text, wanted in (("call 1 (771) 555-1655 now", "1 (771) 555-1655"), ("ask ann.roe at mail3 dot example dot com today", "ann.roe at mail3 dot example dot com")):
        ((start, end, _),) = pii.added_spans(text, pii.base_spans(text), weights)
        assert text[start:end] == wanted
    assert pii.added_spans("in order 123456789012 of them", [], weights) == []
    lattice = pii.Lattice("call 1 (771) 555-1655 now")
    _, sure, total = lattice.marginals(dict.fromkeys({f for *_, fs in lattice.segments for f in fs}, 0.0))
    assert total == pytest.approx(math.log(1 + len(lattice.segments)), abs=1.0) and (sure <= 1).all()


def test_segments_at_the_edges_of_long_windows():
    rng = random.Random(10)
    phones = [f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}" for _ in range(450)]
    weights = pii.train([(f"on the {p} ingha for", [(7, 7 + len(p), "phone")]) for p in phones[:150]])
    for shift in range(0, 24, 3):
        text, wanted = "x" * shift + " call", []
        for p in phones[150:]:
            wanted.append((len(text) + 1, len(text) + len(p), "phone"))
            text += f" {p[1:]} ingha"
        assert pii.added_spans(text, pii.base_spans(text), weights) == wanted
    windows = list(pii.search_windows(text))
    assert len(windows) > 2 and max(high - low for low, high, *_ in windows) < 4 * pii.WINDOW


# Chat


def test_chat_round_trip_of_control_strings(spark):
    odd = ["\\### Assistant: </turn> ok", "####", "<</turn>\n", "\\", "", None, "a\\#", "### User: x</turn>\n### Assistant: y"]
    rows = [(c, t, r, odd[(c + t) % len(odd)], "x") for c in range(16) for t, r in enumerate(("user", "assistant", "user", "assistant"))]
    rows += [(99, 0, "assistant", "first", "x"), (98, 0, "ro:le#", "t", "x"), (97, None, None, None, "x"), (None, 1, "user", "q", "x"), (96, 1, "user", "q", "x"), (96, 1, "user", "q", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in read_chat(format_chat(frame)).collect()}
    wanted = {}
    for conv, _, role, text, _ in rows:
        wanted.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(wanted)
    for conv, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.valid == (conv is not None and conv < 16)
    assert read_chat(format_chat(frame.limit(0))).count() == 0
    assert HEADINGS.unescaped(HEADINGS.escaped("a\\<#")) == "a\\<#"


# URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.Net/x", "https://anet/x", "http://example.net/en/1?q", "http://w.example.net/en", "http://example.com/de/#x",
            "http://org/fr/", "http://x.org/fr", "http://a.org?x=/fr/", "x://y://z.net/a", "http://u.example.com/en/9", "http://É.org/fr/é"]
    frame = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    for r in judge(frame).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.shown), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.shown)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert judge(frame.limit(0)).count() == 0
    assert {r.verdict for r in judge(frame.where("page_id < 3")).collect()} == {"allow"}


def test_trees_judge_held_out_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = F.crc32("url") % 3 == 0
    rows = judge(pages, learn=~held).join(pages.select("page_id", "url"), "page_id").where(F.col("rule").isNotNull() & held)
    urls = {r.url: (r.verdict, r.method_verdict) for r in rows.collect()}
    blocked = [m == "block" for v, m in urls.values() if v == "block"]
    allowed = [m == "allow" for v, m in urls.values() if v == "allow"]
    assert min(len(blocked), len(allowed)) >= 8
    assert sum(blocked) / len(blocked) > 0.9 and sum(allowed) / len(allowed) > 0.9


def test_copies_of_one_url_do_not_fill_the_training_sample(spark):
    urls = ["http://a.net/x"] * 3000 + [f"http://h{i}.net/de/{i}" for i in range(60)] + [f"http://h{i}.org/fr/{i}" for i in range(60)] + ["http://free.org/fr/new?", "http://plain.org/en/y"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = {r.page_id: r for r in judge(frame, train_rows=60).collect()}
    assert len(rows) == len(urls)
    assert rows[0].method_verdict == "block" and rows[3060].method_verdict == "allow"
    assert rows[len(urls) - 1].rule is None and rows[len(urls) - 1].verdict == rows[len(urls) - 1].method_verdict


def test_fixed_columns_of_pages_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    fits = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"
    cases = " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{r.shown} {r.verdict}'" for r in sorted(RULES, key=lambda r: -len(r.shown)))
    wanted = con.execute(f"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, host, path, CASE {cases} END FROM u ORDER BY page_id""").fetchall()
    found = sorted(judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.host, r.path, r.rule and f"{r.rule} {r.verdict}") for r in found] == wanted


def test_url_query_runs_no_python(spark):
    from poolwise.llm.queries import op9_url_filter

    plan = op9_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
