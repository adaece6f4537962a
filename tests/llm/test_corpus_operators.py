"""Operators across documents against brute force: sharding, joins, passages, leaks, conversations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import components, decontamination, jaccard_join, reply_trees, sharding, substring_dedup


def words(rng, n, k=400):
    return [rng.choice("abcdef") + str(rng.randint(0, k)) for _ in range(n)]


# sharding


@pytest.mark.parametrize("k", [1, 7, 40])
def test_shards(docs_of, k):
    rng = random.Random(k)
    texts = [" ".join(words(rng, 5)) for _ in range(150)]
    texts += [t for t in texts[:20] for _ in range(rng.randint(1, 3))] + ["hot copy"] * 90 + [None, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "x")]
    got = sharding.shard_documents(docs_of(rows), k).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[j] for j in range(k)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    groups = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id < 150 and text[r.doc_id] is not None:
            groups[text[r.doc_id]].add(r.shard)
    whole = [len(g) == 1 for g in groups.values()]
    assert sum(whole) >= 0.9 * len(whole)
    assert sharding.shard_documents(docs_of([]), k).count() == 0


def test_few_groups_are_split_where_most_rows_are_linked(docs_of):
    texts = [f"pair {i // 2}" for i in range(1600)] + [f"ten {i // 10}" for i in range(1200)] + [f"single {i}" for i in range(200)]
    random.Random(3).shuffle(texts)
    got = sharding.shard_documents(docs_of(texts), 20).collect()
    assert set(Counter(r.shard for r in got).values()) == {150}
    groups = defaultdict(set)
    for r in got:
        groups[texts[r.doc_id]].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 0.05 * 920


def test_moves_granted():
    assert sharding._granted([(0, 1, 21, 5), (1, 2, 21, 4), (2, 0, 21, 3)], [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}
    assert sharding._granted([(0, 1, 20, 5), (3, 1, 21, 4), (1, 2, 20, 9)], [0, 1, 4, 0]) == {(1, 2): 4, (3, 1): 4, (0, 1): 1}
    rng = random.Random(8)
    for _ in range(200):
        k = rng.randint(2, 7)
        room = [rng.choice([0, 0, rng.randint(0, 9)]) for _ in range(k)]
        asked = {(a, b, rng.randint(18, 22)): rng.randint(1, 9) for a in range(k) for b in range(k) if a != b and rng.random() < 0.5}
        got = sharding._granted([(*f, n) for f, n in asked.items()], room)
        net = [sum(n for (_, b), n in got.items() if b == j) - sum(n for (a, _), n in got.items() if a == j) for j in range(k)]
        assert all(x <= y for x, y in zip(net, room, strict=True))
        assert all(0 < n <= sum(m for (x, y, _), m in asked.items() if (x, y) == f) for f, n in got.items())
        assert got or not any(room[b] for _, b, _ in asked)


# similarity


def similar(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("bits", "centres", "shingle", "percent"), [(22, 2, 4, 85), (3, 0, 4, 85), (12, 1, 5, 80), (8, 3, 3, 60)])
def test_similarity_join(docs_of, bits, centres, shingle, percent):
    rng = random.Random(bits)
    passage, rows = words(rng, 40, 9999), []
    for _ in range(18):
        base = words(rng, rng.randint(5, 60))
        for _ in range(rng.randint(1, 14)):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"E{rng.randint(0, 99)}"
            if rng.random() < 0.3:
                w = w + passage
            elif rng.random() < 0.2:
                w = passage + w[: rng.randint(0, 8)]
            rows.append((len(rows) * 7 + 3, " ".join(w)))
    rows += [(9001, None), (9002, ""), (9003, "one"), (9004, "ONE"), (9005, "a b"), (9006, "  "), (9007, "é É"), (9008, "q " * 50_000)]
    rows += [rows[0], (1, rows[0][1])]
    got = jaccard_join.similarity_components(docs_of(rows), shingle=shingle, percent=percent, sketch_bits=bits, centres=centres)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == similar(rows, shingle, percent)


def test_near_copies_that_do_not_all_link(docs_of, spark):
    rng = random.Random(11)
    base, rows = words(rng, 60, 9999), []
    for i in range(600):
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(60)] = f"E{rng.randint(0, 500)}"
        rows.append((i, " ".join(w)))
    want = similar(rows, 4, 85)
    assert 50 < len({c for _, _, c in want}) < 500
    got = jaccard_join.similarity_components(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_similarity_of_nothing(docs_of):
    assert jaccard_join.similarity_components(docs_of([])).count() == 0
    kept = jaccard_join.keep_one_of_each(docs_of(["a b c d e f g h", "a b c d e f g h", None, None, "z"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns[-2:] == ["shard", "n"]


def test_one_of_each_stays_whatever_its_id(docs_of):
    t, u, v = (" ".join(f"{c}{j}" for j in range(30)) for c in "tuv")
    rows = [(3, t), (5, t), (5, u), (6, u + " more"), (None, t + " more"), (None, "only this one"), (None, v), (None, v), (None, v + " more"), (None, None), (None, "")]
    rows += [(8, "a b c d e f g"), (8, "A b c d e f g"), (9, "p q r s t u v w"), (9, "p q r s t u v w"), (9, "P q r s t u v w"), (9, None), (9, None)]
    got = jaccard_join.keep_one_of_each(docs_of(rows))
    kept = sorted(((r.doc_id, (r.text or "").lower().removesuffix(" more"), r.text is None) for r in got.collect()), key=str)
    want = [(3, t), (5, u), (None, "only this one"), (None, v), (None, None), (None, ""), (8, "a b c d e f g"), (9, "p q r s t u v w"), (9, None), (9, None)]
    assert kept == sorted(((i, x or "", x is None) for i, x in want), key=str)
    assert got.columns == docs_of([]).columns


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked
    assert {frozenset(n for n in linked if got[n] == r) for r in set(got.values())} == {frozenset(n for n in linked if root[n] == r) for r in {root[n] for n in linked}}


# passages


def without_repeats(rows, length):
    ws = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, ws, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "shard"), [(8, 512), (9, 2), (12, 1), (35, 512)])
def test_passages(docs_of, length, shard):
    rng = random.Random(length)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            r = rng.random()
            w += rng.choice(passages) if r < 0.4 else ["z", "y"][: rng.randint(1, 2)] * rng.randint(1, 40) if r < 0.5 else words(rng, rng.randint(0, 50))
        rows.append((i, " \n".join(w)))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1002, rows[3][1]), (1003, "only\x1cone " * 2000)]
    got = substring_dedup.remove_repeats(docs_of(rows), length=length, shard=shard)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == without_repeats(rows, length)


def test_no_passages(docs_of):
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="at least"):
        substring_dedup.remove_repeats(docs_of(["a"]), length=3)


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.choice("ab"[: rng.randint(1, 2)]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        times = [rng.randint(1, 2) for _ in texts]
        auto = substring_dedup.SuffixAutomaton()
        for t, n in zip(texts, times, strict=True):
            auto.add(t, n)
        auto.close()
        count = Counter()
        for t, n in zip(texts, times, strict=True):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    count[tuple(t[i:j])] += n
        for t in texts:
            want = [max((k for k in range(1, e + 2) if count[tuple(t[e + 1 - k : e + 1])] > 1), default=0) for e in range(len(t))]
            assert auto.statistics(t) == want


# leaks


def test_leaks(spark, docs_of):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randint(12, 50))) + ". " + " ".join(words(rng, 6))) for i in range(60)]
    rows = [(i, " ".join(words(rng, rng.randint(0, 900)))) for i in range(80)]
    leaked = set()
    for i in range(0, 80, 4):
        j, at = rng.randrange(60), rng.randint(0, len(rows[i][1]))
        rows[i] = (i, rows[i][1][:at] + " " + items[j][1].upper().replace(" ", " - ") + " " + rows[i][1][at:])
        leaked.add((i, j))
    rows += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1])]
    leaked.add((902, 3))
    table = spark.createDataFrame([*items, (700, None), (701, ""), (702, "...")], "item_id bigint, text string")
    got = decontamination.find_leaks(docs_of(rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.leaked} == leaked
    parts = decontamination.find_leaks(docs_of(rows), table, shard_bytes=2000).collect()
    near = lambda rs: sorted((r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in rs)
    assert near(parts) == near(got)
    kept = decontamination.drop_leaks(docs_of(rows), table)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in leaked} and kept.columns == docs_of([]).columns
    assert decontamination.find_leaks(docs_of([]), table).count() == 0
    assert decontamination.find_leaks(docs_of(rows), table.limit(0)).count() == 0


def test_a_leak_is_not_hidden_by_another_passage(spark, docs_of):
    q, a, fill = ([f"{c}{j}" for j in range(n)] for c, n in (("q", 42), ("a", 22), ("f", 250)))
    items = spark.createDataFrame([(1, " ".join(q) + ". " + " ".join(a))], "item_id bigint, text string")
    leak, more = q[:28] + a[:15], q + a[:10]  # shares 0.65 and 0.65; 1.0 and 0.4
    docs = docs_of([(i, " ".join(w)) for i, w in enumerate([leak + fill + more, more + fill + leak, more + fill, leak + fill])])
    got = {r.doc_id: (r.question_overlap, r.answer_overlap, r.leaked) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {0: (0.65, 0.65, True), 1: (0.65, 0.65, True), 2: (1.0, 0.4, False), 3: (0.65, 0.65, True)}
    assert [r.doc_id for r in decontamination.drop_leaks(docs, items).collect()] == [2]


def test_pruning_loses_nothing():
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randint(5, 40), 30))) for i in range(90)]
    frequency = Counter(w for _, t in items for w in set(t.encode().split()))
    for threshold in (0.15, 0.3, 0.5):
        index = decontamination.ItemIndex(items, dict(frequency), len(items), 22.0, decontamination.LeakRules(threshold=threshold))
        own = [{} for _ in index.ids]
        for w, t in index.vocabulary.items():
            for p in range(index.at[t], index.at[t + 1]):
                own[index.item[p]][w] = index.weight[p]
        texts = [" ".join(words(rng, rng.randint(0, 300), 60)).encode() for _ in range(40)]
        want = set()
        for k, t in enumerate(texts):
            w = t.split()
            for j in range(max(1, -(-len(w) // index.half) - 1)):
                have = set(w[j * index.half : (j + 2) * index.half])
                want |= {(k, i) for i, x in zip(index.ids, own, strict=True) if sum(v for u, v in x.items() if u in have) >= threshold}
        assert {h[:2] for h in index.hits(texts)} == want


# conversations


def test_chains_read_back(spark):
    rows = [(1, 0, "user", "hi </turn>\n### Assistant: \\ <\\/turn>"), (1, 1, "assistant", "\\### </turn"), (1, 2, "ro\nle\\", None), (1, 2, None, "tie"), (2, None, "assistant", ""), (2, 5, "assistant", "x" * 100_000), (None, 0, "assistant", "no id"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, leaf string")
    got = reply_trees.read_back(reply_trees.format_reply_trees(reply_trees.chain(df))).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == dict(want)
    assert {r.conv_id: r.loss_text for r in got} == {c: "".join(x for r, x in t if r == "assistant") for c, t in want.items()}
    assert reply_trees.format_reply_trees(reply_trees.chain(df.limit(0))).count() == 0


def test_branches(spark):
    rng = random.Random(9)
    rows = []
    for c in range(12):
        for n in range(rng.randint(1, 25)):
            rows.append((c, n, rng.randrange(n) if n else None, "user", f"m{n}", float(rng.randint(0, 5))))
    rows += [(50, 0, 1, "user", "cycle", 0.0), (50, 1, 0, "user", "cycle", 0.0), (51, 4, 77, "user", "orphan", 1.0)]
    df = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    got = {(r.conv_id, r.path_rank): r for r in reply_trees.read_back(reply_trees.format_reply_trees(df, branches=2)).collect()}
    want = {}
    for c in {r[0] for r in rows} - {50}:
        own = {r[1]: r for r in rows if r[0] == c}
        paths = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own:
                path.append(at)
                at = own[at][2]
            paths.append((-sum(own[n][5] for n in path) / len(path), leaf, path[::-1]))
        for k, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want[c, k] = (leaf, [("user", own[n][4]) for n in path])
    assert {k: (r.leaf, [tuple(t) for t in r.turns]) for k, r in got.items()} == want


def test_only_chosen_paths_make_rows(spark):
    rows = [(1, n, n - 1 if n else None, None if n % 3 else 1.0) for n in range(300)] + [(1, 300 + n, n, -1.0) for n in range(300)] + [(None, 7, None, None), (None, 8, 8, 1.0)]
    df = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, score double")
    assert reply_trees.chosen_paths(df).filter("conv_id = 1").count() == sum(range(2, 302))  # node 299 has a reply, so each leaf is a reply
    best = reply_trees.chosen_paths(df, 1).orderBy("conv_id", "up").collect()
    assert [(r.conv_id, r.leaf, r.path_score, r.node, r.up) for r in best[:1]] == [(None, 7, None, 7, 0)]
    assert [r.node for r in best[1:]] == [597, *range(297, -1, -1)]  # 100 scores of 1 and the reply's; of equal means the least leaf
    assert all(r.path_score == 99 / 101 for r in best[1:])
