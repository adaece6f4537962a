"""Operators on single texts against brute force: quality rules, lines, tokens, classifier, secrets."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import byte_bpe, line_boilerplate, ordinal_quality, secret_forest, suffix_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \t\n ", "one", "\n\n", "a b c d e " * 40, "x" * 300_000, "é \x1c b #*$%&|<>"]


# quality rules


def quality(text, rules):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)

    def covered(least):
        return len({p for i, k in enumerate(longest) if k >= least for p in range(i, i + k)})

    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeat = len({p for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)})
    failed = n < 10 or 100 * repeat > 20 * n
    cover, top = covered(rules.min_repeat), max(longest, default=0)
    bad = 100 * cover > rules.max_covered_percent * n or top > rules.max_longest_words and 100 * top > rules.max_longest_percent * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, cover, top, failed, not failed and not bad)


def test_quality_rules(docs_of):
    rng, rules = random.Random(1), suffix_repeats.RepetitionRules()
    texts = [t for t in EDGE if t is None or len(t) < 1000]
    texts += ["".join(rng.choice(["a", "bb", "#c", "dé", "e<"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("mnop") + str(rng.randint(0, 30)) for _ in range(200)) for _ in range(10)]
    texts += [texts[-1], texts[-1] + " " + texts[-2] + " " + texts[-1]]
    got = {r[0]: tuple(r)[1:] for r in suffix_repeats.measure_repetition(docs_of(texts)).collect()}
    assert got == {i: quality(t, rules) for i, t in enumerate(texts)}
    kept = suffix_repeats.measure_repetition(docs_of(texts), keep=("doc_id", "shard"), only_kept=True)
    assert kept.columns == ["doc_id", "shard"] and {r[0] for r in kept.collect()} == {i for i, r in got.items() if r[-1]}
    assert suffix_repeats.measure_repetition(docs_of([])).count() == 0
    assert suffix_repeats.measure_repetition(docs_of(["y" * 200_000, "a b " * 30_000])).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=5))
def test_longest_repeats(texts):
    codes = np.array([c for t in texts for c in t], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    want = []
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
    assert suffix_repeats.longest_repeats(codes, starts).tolist() == want


# lines


def test_lines_of_a_site(spark):
    rows = [(i, f"own {i}\nmenu\n\nrare {i % 7}\nmenu", "big") for i in range(60)] + [(100 + i, "menu\nother", None) for i in range(12)] + [(200, None, "big"), (201, "", "big"), (202, "menu\nx", "small"), (0, "own 0\nmenu\n\nrare 0\nmenu", "big")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, source string, lines string")
    got = sorted((tuple(r) for r in line_boilerplate.drop_boilerplate(df).collect()), key=str)
    pages = Counter(s for _, _, s in rows)
    lines = Counter((s, x) for _, t, s in rows if t is not None for x in set(t.split("\n")) if WORD.search(x))
    want = []
    for i, t, s in rows:
        all_ = [] if t is None else t.split("\n")
        kept = [x for x in all_ if not (WORD.search(x) and pages[s] >= 10 and lines[s, x] >= 4 and 100 * lines[s, x] > 8 * pages[s])]
        want.append((i, s, len(all_), len(all_) - len(kept), None if t is None else "\n".join(kept)))
    assert got == sorted(want, key=str)
    assert line_boilerplate.drop_boilerplate(df.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def encoders():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    return byte_bpe.loaded(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="ab \n'slé1", max_size=80) | st.text(alphabet="thereoning", max_size=60))
def test_tokens_like_tiktoken(encoders, text):
    own, other = encoders
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(packed) == text.encode()


def test_token_query(docs_of, encoders):
    texts = [*EDGE, "the end", "the end"]
    df = byte_bpe.encode_documents(docs_of(texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in df.collect():
        ids = encoders[1].encode_ordinary(texts[r.doc_id] or "")
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(ids), hashlib.sha256(packed).hexdigest(), packed)
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs_of([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_another_vocabulary():
    path = P.path("byte_bpe_50k.tiktoken")
    own, other = byte_bpe.ByteBPE(byte_bpe.load_ranks(path), P.PATTERN), tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("abcdeinorst    é中\n12") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)


# classifier


def test_classifier_on_held_out_documents(spark, docs_of):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    rows, grades = [], []
    for i in range(2700):
        g = i % 3
        words = [rng.choice(pool) for _ in range(rng.randint(20, 80))]
        if g == 0:
            words = [w.upper() + "!!" for w in words]
        elif g == 1:
            words[rng.randrange(len(words))] = rng.choice(["scum", "moron"])
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    docs = docs_of(rows + [(5000, None), (5001, ""), (5002, rows[2][1]), (5003, "z" * 200_000)])
    ratings = spark.createDataFrame([x for x in grades if x[0] < 2100] + [(1, None), (None, 2), (9999, 1)], "doc_id bigint, grade int")
    model = ordinal_quality.train(docs, ratings)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in ordinal_quality.score_documents(docs, model, keep=("doc_id", "shard")).collect()}
    right = [(got[i].selected, g == 2) for i, g in grades if i >= 2100]
    assert sum(a == b for a, b in right) > 0.95 * len(right)
    assert got[5002].p_top == got[2].p_top and 0 <= got[5000].expected_grade <= 2 and got[5000].p_top == got[5001].p_top
    assert ordinal_quality.score_documents(docs.limit(0), model).count() == 0
    assert ordinal_quality.train(docs, ratings.limit(0)) is None
    assert {r.selected for r in ordinal_quality.score_documents(docs, None).collect()} == {True}


def test_fit_is_the_greatest_likelihood():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(400)]
    truth = rng.normal(0, 1.5, 12)
    y = np.digitize([truth[r].sum() + rng.logistic() for r in rows], [-1.0, 0.5, 2.0])
    model = ordinal_quality.fit_ordinal(rows, y, 4, bits=4, small=1e-12)

    def loss(w, cuts):  # of the model's definition, row by row
        total = 0.0
        for r, grade in zip(rows, y, strict=True):
            below = [0.0, *(1 / (1 + np.exp(-(c - w[r].sum()))) for c in cuts), 1.0]
            total -= np.log(below[grade + 1] - below[grade])
        return total / len(rows) + 1e-3 / 2 * (w @ w)

    w, cuts = model.weights.astype(float), model.cuts
    best = loss(w, cuts)
    for i in range(12 + 3):
        for d in (0.02, -0.02):
            step = np.eye(19)[i if i < 12 else i + 4] * d
            assert loss(w + step[:16], cuts + step[16:]) > best
    assert (np.diff(cuts) > 0).all() and np.corrcoef(w[:12], truth)[0, 1] > 0.95


def test_grades_are_counted_over_all_ratings(spark, docs_of):
    docs = docs_of([(i, f"{'good' if i % 2 else 'bad'} text {i}") for i in range(40)])
    ratings = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(777, 3)], "doc_id bigint, grade int")
    model = ordinal_quality.train(docs, ratings)
    assert len(model.cuts) == 3 and np.isfinite(model.cuts).all() and (np.diff(model.cuts) > 0).all()


def test_features_by_word():
    seen = ordinal_quality.features("Ünïcöde ABC--abc 12!! 12!! x".encode())
    h = lambda kind, what: ordinal_quality._hash(kind, what.encode(), ordinal_quality.BITS)
    want = {h(b"w", "ünïcöde"), h(b"4", "ünïc"), h(b"5", "ünïcö"), h(b"w", "abc--abc"), h(b"4", "abc-"), h(b"5", "abc--"), h(b"w", "12"), h(b"w", "x")}
    assert want <= set(seen.tolist())
    assert len(seen) == len(set(seen.tolist())) == len(want) + 3 + 3  # the shapes a, A--a and 0!!, and three shares
    assert list(ordinal_quality.features(b" \n")) == [h(b"e", "")]


# secrets


def single_feature_accuracy(train, test, f):
    """Of the best threshold on one feature, taken from the training rows."""
    best = max(((sum((r[f] > cut) == (r.label == up) for r in train), cut, up) for cut in sorted({r[f] for r in train}) for up in (0, 1)), key=lambda x: x[0])
    return sum((r[f] > best[1]) == (r.label == best[2]) for r in test) / len(test)


def test_forest_beats_each_feature_on_held_out_findings(spark):
    known = [(1 << 26) - 1] * 26 * 26
    planted = secret_forest.planted_findings(spark, known, 1400)
    rows = planted.collect()
    assert len(rows) == 1400 and {len(str(r.candidate)) >= 16 for r in rows} == {True}
    fit, held = planted.filter("doc_id % 4 != 0"), planted.filter("doc_id % 4 = 0")
    got = secret_forest.score_findings(held, secret_forest.train_forest(fit)).collect()
    right = sum(r.is_secret == (r.label == 1) for r in got) / len(got)
    train = [r for r in rows if r.doc_id % 4]
    assert right >= 0.95 and right > max(single_feature_accuracy(train, got, f) for f in secret_forest.FEATURES) + 0.05
    harmless = [r for r in got if r.label == 0 and r.hex == 1.0]
    assert len(harmless) > 30 and sum(r.is_secret for r in harmless) <= 0.1 * len(harmless)
    assert any(r.is_secret != (r.before_key == 1.0) for r in got)


def test_candidates_and_features_against_python(spark):
    texts = ["a b /x-y/zzzzzzzzzzzzzzzz=abcdefghijklmnop,abcdefghijklmnop! next  line", None, "", "short", "Q" * 40_000 + " end", "one abcdefghij1234567890", ",".join(["k" * 16] * 2500), "é=abcdefghijklmnopé"]
    df = spark.createDataFrame([(i, t, None, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, nth int, length int")
    got = {(r.doc_id, r.nth): (r.candidate, r.lead, r.rest, r.before, r.after) for r in secret_forest.candidates(df).collect()}
    want = {}
    for d, t in enumerate(texts):
        words, n = re.split(r"[\x20\x09-\x0D]+", t or ""), 0
        at = lambda i: words[i] if 0 <= i < len(words) else ""  # noqa: B023, E731
        for i, w in enumerate(words):
            found, between = re.findall(secret_forest.CANDIDATE, w), re.split(secret_forest.CANDIDATE, w)
            for j, c in enumerate(found):
                want[d, n] = (c, between[j], between[j + 1], " ".join((at(i - 2), at(i - 1), between[j])), " ".join((between[j + 1], at(i + 1))))
                n += 1
    assert got == want and len(want) > 2500
    grams = spark.createDataFrame([("abc",), ("bcd",), ("kkk",)], "gram string")
    known = secret_forest.packed(grams)
    rows = secret_forest.with_features(secret_forest.candidates(df), known).select("candidate", "coverage", "transitions", "different", "length").distinct().collect()
    for r in rows:
        c, low = r.candidate, r.candidate.lower()
        kind = ["0" if x.isdigit() else "A" if x.isupper() else "a" if x.islower() else "-" for x in c]
        assert r.length == len(c) and r.coverage == pytest.approx(sum(low[i : i + 3] in ("abc", "bcd", "kkk") for i in range(len(c) - 2)) / (len(c) - 2))
        assert r.transitions == pytest.approx(sum(x != y for x, y in zip(kind, kind[1:], strict=False)) / (len(c) - 1)) and r.different == pytest.approx(len(set(c)) / min(len(c), 64))


def test_secrets_of_a_corpus(spark):
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, truth = [], {}
    for i in range(300):
        kind = i % 5
        c = ["AKIA" + "".join(rng.choice("0123456789ABCDEF") for _ in range(16)), hexa(40), "".join(rng.choice("0123456789") for _ in range(16)), "".join(rng.choice(["ther", "ing", "tion", "and"]) for _ in range(6)), hexa(40)][kind]
        before = ["key is ", 'token = "', "call ", "the ", "commit "][kind]
        rows.append((i, f"some ordinary words here thering {before}{c}{'"' if kind == 1 else ''} and more", "src/app.py"))
        truth[i] = kind < 2
    rows += [(1000, None, None), (1001, "", None), (1002, "no finding", None), (1003, rows[0][1], None), (1004, "p" * 100_000, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, length int")
    found = {r.doc_id: r.is_secret for r in secret_forest.scan_secrets(df).collect()}
    assert set(found) == {*truth, 1003, 1004}
    assert sum(found[i] == t for i, t in truth.items()) >= 285
    assert secret_forest.scan_secrets(df.limit(0)).count() == 0
    own = secret_forest.scan_secrets(df, lambda f: f.filter("doc_id < 3").withColumn("label", F.lit(1))).collect()
    assert {r.is_secret for r in own} == {True} and {r.p_secret for r in own} == {1.0}
