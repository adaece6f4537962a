"""Substring dedup: words in a long passage that also starts elsewhere are removed, by suffix automata.

A reference automaton is built for each shard of passages that can repeat at all, and the passages of the
documents are streamed through the shard's automaton for their matching statistics: at each word, the
longest run that ends there and occurs twice or more.  Where it reaches the threshold, the words go.

Shards.  Automata of the whole corpus would have no size bound, so they are not sent to all documents.
Each window of ``length`` words names the least hash of the word n-grams in it, its anchor.  Equal windows
have equal anchors, so all that can match meets at one anchor: neighbouring windows with one anchor make a
passage, anchors that occur once are dropped, and equal passages of a shard are counted before they are
gathered, so a passage that a third of all documents share is one row.  The automata of a shard are bounded
by ``SHARD`` different passages; shards of more (a passage in very many different surroundings) are
resolved by counting digests of their single windows instead, which is exact too and spreads freely.

Defined results: a null text has no words and keeps nothing, as an empty one.  Repeated rows repeat each
other, so both lose all words if they have ``length`` of them.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .words import chunks, hash_words, mix, roll, texts_of

#: Words of the n-grams that windows are anchored by, and most different passages of a shard's automaton.
GRAM, SHARD = 8, 512


def window_minima(x, w: int):
    """The least of each w consecutive entries."""
    import numpy as np

    if len(x) < w:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    n = len(x) - w + 1
    return np.minimum(m[:n], m[w - size : w - size + n])


def runs_of(words: list[list[bytes]], length: int):
    """Runs of neighbouring windows with one anchor: text number, first window, windows, anchor, and 2 if the
    anchor's n-gram stands in the run more than once (the run may then repeat itself), else 1."""
    import numpy as np

    h, starts = hash_words(words)
    grams = roll(h, GRAM)
    w = length - GRAM + 1
    low = window_minima(grams, w)
    n_win = np.maximum(np.diff(starts) - length + 1, 0)
    text = np.repeat(np.arange(len(words)), n_win)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    pos = starts[:-1][text] + at
    v = low[pos] if len(pos) else np.empty(0, np.uint64)
    if not len(v):
        return text, at, at, v.astype(np.int64), at
    new = np.empty(len(v), bool)
    new[0] = True
    new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(v)))
    span = np.arange(w)
    twice = np.empty(len(first), np.int64)
    for k in range(0, len(first), 1 << 16):
        f, s = first[k : k + (1 << 16)], size[k : k + (1 << 16)]
        head, tail = grams[pos[f][:, None] + span] == v[f][:, None], grams[pos[f + s - 1][:, None] + span] == v[f][:, None]
        twice[k : k + (1 << 16)] = 1 + (pos[f] + head.argmax(1) != pos[f + s - 1] + w - 1 - tail[:, ::-1].argmax(1))
    return text[first], at[first], size, mix(v[first]).view(np.int64), twice


class SuffixAutomaton:
    """Of several word sequences; ``often`` tells of each state whether its runs occur twice or more."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def add(self, words: list, times: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += times
                continue
            cur = None
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(times)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                p = last
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            count.append(0)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur is None:
                last = clone
                count[clone] += times
            else:
                link[cur] = clone
                last = cur

    def close(self) -> None:
        """Sum counts over suffix links, and note for each state the longest suffix that occurs twice."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:
            self.count[self.link[s]] += self.count[s]
        self.twice = [0] * len(self.len)
        for s in reversed(order):
            self.twice[s] = self.len[s] if self.count[s] > 1 else self.twice[self.link[s]]

    def statistics(self, words: list) -> list[int]:
        """For each word of a sequence that was added, the longest run that ends there and occurs twice."""
        state, out = 0, []
        for w in words:
            state = self.next[state][w]
            out.append(self.twice[state])
        return out


def _spans(ends: list[int], length: int) -> list[int]:
    """Words (first, after last, ...) covered by the windows that end at the given words."""
    out: list[int] = []
    for e in ends:
        if out and e - length + 1 <= out[-1]:
            out[-1] = e + 1
        else:
            out += [e - length + 1, e + 1]
    return out


def _solve(group: list[tuple[str, int]], length: int) -> list[list[int]]:
    """Spans to remove for each (passage, times) of one anchor."""
    words = [p.split(" ") for p, _ in group]
    if len(group) == 1 and group[0][1] > 1:
        return [[0, len(words[0])]]
    auto = SuffixAutomaton()
    for ws, (_, times) in zip(words, group, strict=True):
        auto.add(ws, min(times, 2))
    auto.close()
    return [_spans([i for i, n in enumerate(auto.statistics(ws)) if n >= length], length) for ws in words]


def _key(text: Column) -> list[Column]:
    """Names a text, so that rows need no id of their own."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in chunks(batch):
                text, at, size, v, twice = runs_of([t.split() for t in texts_of(part)], length)
                key = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(key), part.column("k2").take(key), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(v, pa.int64()), pa.array(twice, pa.int32())], names=["k1", "k2", "at", "size", "v", "c"])

    return map_arrow(docs.select("k1", "k2", "__text"), run, "k1 bigint, k2 bigint, at int, size int, v bigint, c int")


def _passages(asked: DataFrame, length: int) -> DataFrame:
    """(k1, k2, at, v, times, passage) for documents with lists of runs; equal neighbours are counted, not repeated."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["k1", "k2", "at", "v", "times", "passage"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def rows(key, text, runs, times):
            words = (text or "").encode().split()
            for r in runs:
                yield (*key, r["at"], r["v"], times, b" ".join(words[r["at"] : r["at"] + r["size"] + length - 1]).decode())

        out: list[tuple] = []
        for batch in batches:
            held = None
            for k1, k2, text, runs in zip(*(batch.column(c) for c in ("k1", "k2", "__text", "runs")), strict=True):
                key = (k1.as_py(), k2.as_py())
                if held and held[0] == key:
                    held[3] += 1
                    continue
                if held:
                    out += rows(*held)
                held = [key, text.as_py(), runs.as_py(), 1]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if held:
                out += rows(*held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return map_arrow(asked, run, "k1 bigint, k2 bigint, at int, v bigint, times bigint, passage string")


def _by_automata(refs: DataFrame, length: int) -> DataFrame:
    """refs (v, h1, h2, passage, times), sorted by v within partitions: adds spans."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def flush(done):
            if done:
                v, h1, h2, spans = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["v", "h1", "h2", "spans"])

        def solved(group):
            for (v, h1, h2, _, _), spans in zip(group, _solve([(p, n) for *_, p, n in group], length), strict=True):
                if spans:
                    yield v, h1, h2, spans

        done: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("v", "h1", "h2", "passage", "times")), strict=True):
                if held and held[0][0] != row[0]:
                    done += solved(held)
                    held = []
                held.append(row)
            if len(done) >= 10_000:
                yield from flush(done)
                done = []
        if held:
            done += solved(held)
        yield from flush(done)

    return map_arrow(refs.select("v", "h1", "h2", "passage", "times"), run, "v bigint, h1 bigint, h2 bigint, spans array<int>")


def _by_windows(refs: DataFrame, length: int) -> DataFrame:
    """The same for shards of any size, by counting the digests of windows."""
    words = refs.select("v", "h1", "h2", "times", F.split("passage", " ").alias("w"))
    each = words.select("v", "h1", "h2", "times", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, F.lit(length)), " "))).alias("at", "win"))
    each = materialize(each.select("v", "h1", "h2", "times", "at", F.xxhash64("win").alias("d1"), F.xxhash64(F.lit(1), "win").alias("d2")), "windows")
    often = each.groupBy("d1", "d2").agg(F.sum("times").alias("n")).filter("n > 1").select("d1", "d2")
    hit = each.join(often, ["d1", "d2"]).groupBy("v", "h1", "h2").agg(F.collect_list("at").alias("at"))
    pairs = F.flatten(F.transform("at", lambda i: F.array(i, i + length)))
    return hit.select("v", "h1", "h2", pairs.cast("array<int>").alias("spans"))


def _cut(docs: DataFrame, keep: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            n, removed, sha, left = [], [], [], []
            for text, spans in zip(batch.column("__text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                gone = bytearray(len(words))
                for s in spans.as_py() or ():
                    for a, b in zip(s["spans"][::2], s["spans"][1::2], strict=True):
                        a, b = s["at"] + a, s["at"] + b
                        gone[a:b] = b"\x01" * (b - a)
                removed.append(sum(gone))
                kept = b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone, strict=True) if not g])
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=[*keep, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_arrow(docs.select(*keep, "__text", "spans"), run, f"{schema}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, *, length: int = 35, shard: int = SHARD, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, then n_words, n_removed, kept_sha256 and kept_text (words joined by spaces)."""
    if length < GRAM:
        raise ValueError(f"passages of at least {GRAM} words are asked for")
    src = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    keyed = src.select("*", *_key(F.col("__text")))
    runs = materialize(_runs(keyed, length), "runs")
    again = runs.groupBy("v").agg(F.sum("c").alias("n")).filter("n > 1").select("v")
    asks = runs.select("k1", "k2", "at", "size", "v").distinct().join(again, "v").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size", "v")).alias("runs"))
    asks = materialize(asks, "asks")
    asked = keyed.select("k1", "k2", "__text").join(asks, ["k1", "k2"])
    passages = materialize(_passages(asked, length).withColumn("h1", F.xxhash64("passage")).withColumn("h2", F.xxhash64(F.lit(1), "passage")), "passages")
    refs = passages.groupBy("v", "h1", "h2").agg(F.sum("times").alias("times"), F.first("passage").alias("passage"))
    refs = materialize(refs, "references")
    large = materialize(refs.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > shard).select("v"), "large")
    small = refs.join(large, "v", "left_anti").repartition("v").sortWithinPartitions("v")
    spans = materialize(_by_automata(small, length).unionByName(_by_windows(refs.join(large, "v", "left_semi"), length)), "spans")
    found = passages.select("k1", "k2", "at", "v", "h1", "h2").distinct().join(spans, ["v", "h1", "h2"])
    # written, so that the join below starts from plain exchanges, whose large partitions can be split
    found = materialize(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "spans")).alias("spans")), "found")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text")
    return _cut(keyed.join(found, ["k1", "k2"], "left"), list(keep), own)


def oracle(length: int = 35) -> str:
    """``remove_repeats`` without the texts, in DuckDB's SQL, over ``documents``."""
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + {length - 1}], ' ') AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM w)),
hit AS (SELECT r, i FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS j FROM hit, range({length}) x(k)),
word AS (SELECT r, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT word.r, string_agg(v, ' ' ORDER BY word.j) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.r = word.r AND gone.j = word.j GROUP BY word.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r
"""
