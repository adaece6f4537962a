"""Benchmark decontamination: BM25 with block-max pruning, then overlap of question and answer.

Each document is cut into passages of half-overlapping words, long enough that every test item lies whole
in one.  A passage is a query against an inverted index of the items.  An item's score is divided by its
score against its own text, so one threshold holds for all items.

All passages of a block of documents are queried at once.  Terms are numbered by their upper bound.  In
each passage the terms of low bound whose bounds together stay below the threshold cannot lift an item
over it alone, so only the postings of the others (the pivot and what follows) name blocks of items; a
block whose greatest weights, with all those low bounds, still stay below is skipped; items of the blocks
left are scored exactly.  Nothing over the threshold is lost.

The index is sent to the workers in shards of at most ``shard_bytes`` of items; documents are streamed
past each shard.  Statistics (document frequencies, lengths) are those of all items in every shard.

Defined results: null and empty texts have one empty passage and no hits; items without words, or null,
are never hit; rows are independent, so repeated rows repeat their hits; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .words import chunks, forget, texts_of

#: Bytes of text that are queried at once, about; bounds a worker's memory (some 80 bytes for each, with 200 items).
BLOCK_BYTES = 1 << 19
#: ASCII that isn't a letter or digit separates words; other characters belong to words.
_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


@dataclass(frozen=True)
class LeakRules:
    """Scores count from ``threshold`` of an item's score against itself.  A leak holds at least
    ``overlap`` of the ``gram``-grams of the question, and of the answer."""

    threshold: float = 0.6
    overlap: float = 0.6
    gram: int = 3
    k1: float = 1.2
    b: float = 0.75
    block: int = 16


def normal_words(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_SEPARATORS).split()


def question_and_answer(words: list[bytes], text: bytes) -> int:
    """Words of the question; the rest is the answer: the last sentence, or the last third if that is all."""
    sentences = [s for s in (normal_words(s) for s in text.replace(b"\n", b" ").split(b". ")) if s]
    last = len(sentences[-1]) if len(sentences) > 1 else 0
    return len(words) - (last if 3 <= last < len(words) else max(1, len(words) // 3))


def _distinct(keys):
    import numpy as np

    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _sums(keys, weights):
    """Distinct keys, and the sum of the weights of each."""
    import numpy as np

    if len(keys) and keys.max() < 2 * len(keys) + (1 << 20):  # a table of all keys is small
        total = np.bincount(keys, weights)
        there = np.flatnonzero(total)  # weights are above 0
        return there, total[there]
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights, len(keys))


class ItemIndex:
    """Inverted index over items (item id, text), blocked by position, with weights normed to self-scores."""

    def __init__(self, items: list[tuple], frequency: dict[bytes, int], n_items: int, mean_length: float, rules: LeakRules, longest: int = 0):
        import numpy as np

        self.rules, self.ids, self.parts = rules, [], []
        docs = []
        for item_id, text in items:
            raw = (text or "").encode()
            words = normal_words(raw)
            if words:
                cut = question_and_answer(words, raw)
                self.ids.append(item_id)
                self.parts.append((self.grams(words[:cut]), self.grams(words[cut:])))
                docs.append(words)
        terms, item, weight = [], [], []
        names: dict[bytes, int] = {}
        for i, words in enumerate(docs):
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = rules.k1 * (1 - rules.b + rules.b * len(words) / max(mean_length, 1e-9))
            own = {w: np.log1p((n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (rules.k1 + 1) / (n + norm) for w, n in tf.items()}
            total = sum(own.values())
            for w, x in own.items():
                terms.append(names.setdefault(w, len(names)))
                item.append(i)
                weight.append(x / total)
        terms, item, weight = np.array(terms, np.int64), np.array(item, np.int64), np.array(weight, np.float64)
        bound = np.zeros(len(names))
        np.maximum.at(bound, terms, weight)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(bound, kind="stable")] = np.arange(len(names))  # low bounds first
        self.vocabulary = {w: int(rank[t]) for w, t in names.items()}
        self.bound = np.sort(bound)
        terms = rank[terms]
        by = np.lexsort((item, terms))
        self.item, self.weight = item[by], weight[by]
        self.at = np.searchsorted(terms[by], np.arange(len(names) + 1))
        block = self.item // rules.block
        key = terms[by] * (len(docs) + 1) + block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.block = block[first]
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_at = np.searchsorted(terms[by][first], np.arange(len(names) + 1)) if len(first) else np.zeros(len(names) + 1, np.int64)
        self.half = max(64, longest, *map(len, docs))

    def grams(self, words: list[bytes]) -> frozenset:
        n = min(self.rules.gram, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()

    def hits(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """(text number, item id, score, question overlap, answer overlap), the best passage of each: a leak
        if there is one, then by the sum of the overlaps and the score."""
        import numpy as np

        words = [normal_words(t) for t in texts]
        n = [len(w) for w in words]
        get, size, theta = self.vocabulary.get, len(self.vocabulary), self.rules.threshold - 1e-9
        if not size or not sum(n):
            return []
        term = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, sum(n))
        halves = np.maximum(-(-np.array(n) // self.half), 1)
        passages = np.maximum(halves - 1, 1)
        half_at, passage_at = np.cumsum(halves) - halves, np.cumsum(passages) - passages
        text = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        known = term >= 0
        text, inside, term = text[known], inside[known], term[known]
        key = _distinct((half_at[text] + inside // self.half) * size + term)
        of_half, term = key // size, key % size
        text = np.searchsorted(half_at, of_half, "right") - 1
        j = of_half - half_at[text]
        both = np.concatenate([np.minimum(j, passages[text] - 1), np.maximum(j - 1, 0)])
        key = _distinct((np.tile(passage_at[text], 2) + both) * size + np.tile(term, 2))
        of, term = key // size, key % size
        if not len(of):
            return []
        # terms whose bounds together stay below the threshold name no blocks
        ub = self.bound[term]
        total = np.cumsum(ub)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        count = np.diff(np.r_[first, len(of)])
        total -= np.repeat(total[first] - ub[first], count)
        essential = total >= theta
        low = np.bincount(of, np.where(essential, 0.0, ub), int(of[-1]) + 1)

        def spread(rows, at):  # positions in the postings of each row's term, and the row of each
            a, m = at[term[rows]], at[term[rows] + 1] - at[term[rows]]
            row = np.repeat(rows, m)
            return np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m), row

        blocks = len(self.ids) // self.rules.block + 1
        at, row = spread(np.flatnonzero(essential), self.block_at)
        key, most = _sums(of[row] * blocks + self.block[at], self.block_max[at])
        key = key[most + low[key // blocks] >= theta]
        if not len(key):
            return []
        wanted = np.zeros(int(of[-1]) + 1, bool)
        wanted[key // blocks] = True
        at, row = spread(np.flatnonzero(wanted[of]), self.at)
        there = of[row] * blocks + self.item[at] // self.rules.block
        ok = key[np.minimum(np.searchsorted(key, there), len(key) - 1)] == there
        at, row = at[ok], row[ok]
        pair, score = _sums(of[row] * len(self.ids) + self.item[at], self.weight[at])
        best: dict[tuple[int, int], tuple] = {}
        for p, s in zip(pair[score >= theta].tolist(), score[score >= theta].tolist(), strict=True):
            passage, i = divmod(p, len(self.ids))
            t = int(np.searchsorted(passage_at, passage, "right")) - 1
            a = (passage - int(passage_at[t])) * self.half
            have = words[t][a : a + 2 * self.half]
            q, r = (len(part & self._all(have, part)) / len(part) if part else 1.0 for part in self.parts[i])
            rank = (min(q, r) >= self.rules.overlap, q + r, s)  # a passage that is a leak is never hidden by one that isn't
            if (t, i) not in best or rank > best[t, i][1]:
                best[t, i] = ((q, r), rank)
        return [(t, self.ids[i], x[1][2], *x[0]) for (t, i), x in sorted(best.items())]

    def _all(self, words: list[bytes], part: frozenset) -> set:
        n = len(next(iter(part)))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _indexes(items: DataFrame, rules: LeakRules, shard_bytes: int, id_col: str, text_col: str) -> list[ItemIndex]:
    """An index for each shard of items, none over ``shard_bytes`` of text (but for a single larger item)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array([[w.decode() for w in normal_words((t.as_py() or "").encode())] for t in batch.column("text")], pa.list_(pa.string()))], names=["id", "text", "words"])

    src = items.select(items[id_col].alias("id"), items[text_col].alias("text"))
    src = map_arrow(src, run, f"id {dict(src.dtypes)['id']}, text string, words array<string>").filter(F.size("words") > 0)
    src = materialize(src, "items")
    n, total, size, longest = src.agg(F.count(F.lit(1)), F.sum(F.size("words")), F.sum(F.octet_length("text")), F.max(F.size("words"))).first()
    if not n:
        return []
    shards = -(-size // shard_bytes)
    dealt = src.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    counts = src.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for k in range(shards):
        own = dealt.filter(F.col("shard") == k)
        terms = own.select(F.explode("words").alias("w")).distinct()
        frequency = {r[0].encode(): r[1] for r in counts.join(terms, "w", "left_semi").collect()}
        out.append(ItemIndex([(r[0], r[1]) for r in own.select("id", "text").orderBy("id", "text").collect()], frequency, n, total / n, rules, longest))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), *, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, leaked) for all pairs over the threshold."""
    item_type = dict(items.dtypes)[item_col]
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"))
    schema = f"doc_id {dict(src.dtypes)['doc_id']}, item_id {item_type}, score double, question_overlap double, answer_overlap double, leaked boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(items, rules, shard_bytes, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            forget("byte_bpe")
            for batch in batches:
                for part in chunks(batch, most=BLOCK_BYTES):
                    got = sent.value.hits(texts_of(part))
                    t, item, score, q, a = zip(*got, strict=True) if got else [()] * 5
                    leaked = [x >= rules.overlap and y >= rules.overlap for x, y in zip(q, a, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(t, pa.int64())), pa.array(item, *([pa.int64()] if item_type == "bigint" else [])), pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64()), pa.array(leaked, pa.bool_())], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leaked"])

        out = out.unionByName(map_arrow(src, run, schema))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(), *, shard_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with all columns; no shuffle."""
    for index in _indexes(items, rules, shard_bytes, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            forget("byte_bpe")
            for batch in batches:
                for part in chunks(batch, text_col, BLOCK_BYTES):
                    bad = {t for t, _, _, q, a in sent.value.hits(texts_of(part, text_col)) if q >= rules.overlap and a >= rules.overlap}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
