"""The pipeline and each of its stages against brute force, with null and repeated ids."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_text_operators import WORD, quality

import corpus_pipeline
from millrace.llm import byte_bpe, suffix_repeats


def words(rng, n):
    return " ".join(rng.choice("abcdef") + str(rng.randint(0, 9999)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows (doc_id, text, lang, source, n_chars), test items, and the folder that holds them as tables."""
    rng, rows = random.Random(12), []
    items = [words(rng, 20) + ". " + words(rng, 8) for _ in range(6)]
    put = lambda i, t, s: rows.append((i, t, "en", s, None if t is None else len(t)))
    for i in range(40):
        text = "\n".join(words(rng, 12) for _ in range(4))
        if i % 3 == 0:
            text = "Home About Contact\n" + text
        if i % 8 == 0:
            text += "\n" + words(rng, 40) + "\n" + items[i % 6]
        put(i, text, ["one", "two", None][i % 3])
    base = [r[1] for r in rows]
    near = lambda t: t + " more"
    put(50, near(base[1]), "one")
    put(None, near(base[2]), "two")  # a null id may go without the others
    for _ in range(5):
        put(None, words(rng, 30), "two")
    put(None, rows[-1][1], "two")  # of two null ids with one text, one goes
    put(4, base[4], rows[4][3])  # a whole row again
    put(5, words(rng, 30), "one")  # an id again
    put(7, near(base[5]), "one")  # goes, but neither 7 nor 5 go with it
    put(60, None, "one")
    put(61, "", None)
    put(62, "too short", "one")
    put(63, "again and again " * 20, "two")
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, str(folder)


def good(rows, items):
    return [r for r in rows if quality(r[1], suffix_repeats.RepetitionRules())[-1]]


def without_lines(rows, items):
    pages, out = Counter(r[3] for r in rows), []
    lines = Counter((r[3], x) for r in rows if r[1] is not None for x in set(r[1].split("\n")) if WORD.search(x))
    for i, t, lang, s, n in rows:
        left = None if t is None else [x for x in t.split("\n") if not (pages[s] >= 10 and lines[s, x] >= 4 and 100 * lines[s, x] > 8 * pages[s])]
        out.append((i, t, lang, s, n) if t is None or left == t.split("\n") else (i, "\n".join(left), lang, s, len("\n".join(left))))
    return out


def one_of_each(rows, items):
    sets = [(lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})((r[1] or "").lower().split()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = sorted(range(len(rows)), key=lambda a: (rows[a][0] is None, rows[a][0] or 0))
    first = {}
    for a in order:
        first.setdefault(group[a], a)
    return [rows[a] for a in sorted(first.values())]


def clean(rows, items):
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    return [r for r in rows if not any(plain(x) in plain(r[1]) for x in items)]


def tokens(rows, items):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    return [(*r, np.array(other.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in rows]


BRUTE = [good, without_lines, one_of_each, clean, tokens]


def plain(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*[c for c in (*corpus_pipeline.COLUMNS, "ids") if c in df.columns]).collect()), key=str)


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, corpus, k):
    rows, items, folder = corpus
    want = BRUTE[k](rows, items)
    assert k in (1, 4) or len(want) < len(rows)
    got = corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert plain(got) == sorted(want, key=str)


def test_run(spark, corpus):
    rows, items, folder = corpus
    for brute in BRUTE:
        rows = brute(rows, items)
    ids = [r[0] for r in rows]
    assert ids.count(None) == 5 and ids.count(5) == 2 and ids.count(4) == 1 and 50 not in ids
    assert plain(corpus_pipeline.run(spark, folder)) == sorted(rows, key=str)
