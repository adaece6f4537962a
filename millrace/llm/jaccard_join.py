"""Exact Jaccard similarity join on word shingles: a grouped prefix join.

1. Shingles are counted over all documents into a sketch of fixed size, whose levels give one order of all
   shingles: rare ones first, those of one level by their hash.  Any order gives the same result; this one
   keeps common passages out of the prefixes.  The prefix of a set of n is its first n - ceil(t n) + 1, and
   sets that are similar enough share a shingle of their prefixes.
2. Documents with equal shingle sets are one class; classes of equal size and equal prefix are one group.
   Groups are joined by the shingles of their prefixes.  Two sets of x and y shingles that link share at least
   o = ceil(t (x + y) / (1 + t)), so one shared shingle is among the first x - o + 1 of the one and the first
   y - o + 1 of the other; the join asks for both.
3. Pairs of groups are expanded to members.  Each set has a sketch of parities, which differ in no more places
   than the sets do: that proves most pairs apart.  The rest is verified on whole sets.

A list of thousands of near copies would make millions of pairs that all say the same.  So pairs are made in
rounds: first each group with the most central one of its list and size band (that with the most common
shingles: the original of edited copies), each member with the first of its group; then the same with ones
drawn by a hash; then all pairs whose ends are still in different components.  No link between components is
lost, as the last round is complete.

Defined results: texts without words, and nulls, have the empty set, link with nothing and are their own
component.  Fewer words than a shingle make one shingle of all of them.  Repeated rows are documents with
equal sets.  The component of null ids only is null; of ids that tie, the least names the component.  Very long
texts are read whole, some megabytes of text at a time and at least one text.  Further columns, whatever their
names, are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, pick
from .components import connected_components
from .words import chunks, forget, hash_words, roll, texts_of

#: Counters of the sketch, as a power of two: one byte each goes to every worker, whatever the size of the corpus.
SKETCH_BITS = 22
#: Counters in a row of partial counts.
SLICE = 1 << 14
#: Least bits of a sketch of parities; larger sets have as many as shingles, to the next power of two.
PARITY_BITS = 1024
#: Ids that are sent to all executors to fetch or drop their texts (some 40 bytes each); more are joined by a shuffle.
MOST_SENT = 1 << 19
#: Bytes of text whose words a worker holds at once, if it's more than one text.
BLOCK = 1 << 21
#: Rounds in which groups are compared with one of their list only, and the groups that a list has to hold for
#: the rounds after the first; the last round is complete whatever these are.
CENTRES, LONG = 2, 32


def shingle_sets(texts: list[bytes], k: int):
    """For each text, its distinct shingles as sorted 63-bit hashes.  ASCII letters are lower-cased."""
    import numpy as np

    words = [t.lower().split() for t in texts]
    h, _ = hash_words(words)
    rolled = lambda x, n: (roll(x, n) >> np.uint64(1)).astype(np.int64)
    windows, at, out = rolled(h, k), 0, []
    for ws in words:
        n = len(ws)
        if n >= k:
            out.append(np.unique(windows[at : at + n - k + 1]))
        else:
            out.append(rolled(h[at : at + n], n) if n else np.empty(0, np.int64))
        at += n
    return out


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _digest(x) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _parities(s):
    """Of each class of shingles, whether the set has an odd number of them, 64 classes to a number."""
    import numpy as np

    bits = max(PARITY_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> 24) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _folded(x, size):
    """A sketch of parities with fewer classes: halves, quarters and so on are added up."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), lambda i: F.slice(x, i * size + 1, size))
    return F.when(F.size(x) == size, F.col(x)).otherwise(F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), size), lambda a, b: F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))))


def shingle_levels(docs: DataFrame, k: int, bits: int = SKETCH_BITS, text_col: str = "text") -> bytes:
    """For each of 2 ** bits classes of shingles how common it is among all documents, packed: 0 for what chance
    explains, else four steps for each doubling."""
    import numpy as np

    width = 1 << bits
    each = min(SLICE, width)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width, np.uint32)
        forget("byte_bpe")
        for batch in batches:
            for part in chunks(batch, most=BLOCK):
                np.add.at(total, np.concatenate(shingle_sets(texts_of(part), k)) & (width - 1), np.uint32(1))
        rows = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(total.reshape(-1, each)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for i, x in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64)
                total[i] = total[i] + got if i in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])

    partial = map_arrow(docs.select(docs[text_col].alias("__text")), count, "slice int, counts binary")
    counts = np.zeros((width // each, each), np.uint64)
    for i, x in map_arrow(partial.repartition("slice"), add, "slice int, counts binary").collect():  # at most width numbers
        counts[i] = np.frombuffer(zlib.decompress(x), np.uint64)
    counts = counts.ravel().astype(np.float64)
    usual = counts.mean()
    steps = 1 + np.minimum(250, np.floor(4 * np.log2(np.maximum(counts - usual, 1))))
    return zlib.compress(np.where(counts > usual + 6 * np.sqrt(usual) + 8, steps, 0).astype(np.uint8).tobytes(), 1)


def _signatures(docs: DataFrame, levels: bytes, k: int, percent: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, hash, n, core, cls, grp, odd, toks): a hash of the text, the size of its set, how common its
    shingles are, digests of the set and of size and prefix, parities, the prefix; then the long columns ``keep``."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"), F.xxhash64(docs[text_col]).alias("__hash"), *keep)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        level = np.frombuffer(zlib.decompress(levels), np.uint8)
        forget("byte_bpe")
        for batch in batches:
            for part in chunks(batch, most=BLOCK):
                sets = shingle_sets(texts_of(part), k)
                common = [level[s & (len(level) - 1)] for s in sets]
                core = [int(1000 * c.mean()) if len(c) else 0 for c in common]
                prefix = [s[np.argsort(c, kind="stable")[: prefix_length(len(s), percent)]] if len(s) else s for s, c in zip(sets, common, strict=True)]
                digests = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_digest(np.append(p, len(s))) for s, p in zip(sets, prefix, strict=True)], pa.binary())]
                sizes = [pa.array([len(s) for s in sets], pa.int32()), pa.array(core, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__hash"), *sizes, *digests, _lists([_parities(s) for s in sets]), _lists(prefix), *map(part.column, keep)], names=["doc_id", "hash", "n", "core", "cls", "grp", "odd", "toks", *keep])

    return map_arrow(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, hash bigint, n int, core int, cls binary, grp binary, odd array<bigint>, toks array<bigint>" + "".join(f", {c} bigint" for c in keep))


def _sent(rows: DataFrame) -> DataFrame:
    """Narrow rows that are joined with texts, broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, toks) with all shingles, for classes (cid, doc, hash, cls)."""
    ask = _sent(wanted.select("cid", F.col("doc").alias("__id"), F.col("hash").alias("__asked"), "cls"))
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"), F.xxhash64(docs[text_col]).alias("__hash"))
    src = src.join(ask, src["doc_id"].eqNullSafe(ask["__id"]) & (F.col("__hash") == F.col("__asked"))).select("cid", "cls", "__text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget("byte_bpe")
        for batch in batches:
            for part in chunks(batch, most=BLOCK):
                sets = shingle_sets(texts_of(part), k)
                ok = [i for i, (s, c) in enumerate(zip(sets, part.column("cls").to_pylist(), strict=True)) if _digest(s) == c]
                sets = [sets[i] for i in ok]
                yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(ok, pa.int64())), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)], names=["cid", "n", "toks"])

    return map_arrow(src, run, "cid bigint, n int, toks array<bigint>")


class _Join:
    """What the rounds share: classes (cid, doc, hash, cls, gid, size, n, core, odd) and lists (tok, df, gid, n, at, core)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, lists: DataFrame, shingle: int, percent: int, id_col: str, text_col: str):
        self.docs, self.classes, self.lists, self.shingle, self.percent, self.id_col, self.text_col = docs, classes, lists, shingle, percent, id_col, text_col
        self.placed = classes.select("cid", "gid", F.col("cid").alias("root"))

    def tight(self, n, at, m, bt):
        """Whether a shingle at places ``at`` and ``bt`` of sets of n and m may be the one that they must share."""
        o = F.floor((self.percent * (n + m) + 99 + self.percent) / (100 + self.percent))
        return (100 * n >= self.percent * m) & (100 * m >= self.percent * n) & (at <= n - o) & (bt <= m - o)

    def both(self, pairs: DataFrame, sets: DataFrame, *names: str) -> DataFrame:
        side = lambda c: sets.select(F.col("cid").alias(c), *[F.col(x).alias(x + c) for x in names])
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, those that link."""
        both = self.both(pairs.distinct(), self.classes, "n", "odd")
        size = F.least(F.size("odda"), F.size("oddb"))
        apart = F.aggregate(F.zip_with(_folded("odda", size), _folded("oddb", size), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
        maybe = materialize(both.filter((100 + self.percent) * apart <= (100 - self.percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")
        ends = maybe.select(F.col("a").alias("cid")).unionByName(maybe.select(F.col("b").alias("cid"))).distinct()
        wanted = materialize(self.classes.join(ends, "cid", "left_semi").select("cid", "doc", "hash", "cls"), "wanted")
        sets = materialize(_whole_sets(self.docs, wanted, self.shingle, self.id_col, self.text_col), "sets")
        shared = self.both(maybe, sets, "n", "toks").withColumn("i", F.size(F.array_intersect("toksa", "toksb")))
        return materialize(shared.filter(100 * F.col("i") >= self.percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b").distinct(), "links")

    def merge(self, links: DataFrame) -> None:
        """Puts the classes that ``links`` tie together into one component."""
        if links.isEmpty():
            return
        up = lambda c: self.placed.select(F.col("cid").alias(c), F.col("root").alias(f"r{c}"))
        over = connected_components(links.join(up("a"), "a").join(up("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        over = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
        self.placed = materialize(self.placed.join(over, "root", "left").select("cid", "gid", F.coalesce("top", "root").alias("root")), "placed")

    def with_centres(self, nth: int) -> None:
        """Each group with one of its list and size band, each member with one of its group, where their components
        differ.  Only by shingles that must be shared by sets of one size; after the first time, only in long lists."""
        import math

        rank = lambda c: F.struct(F.col("core") if nth == 0 else F.xxhash64(c, F.lit(nth)).alias("core"), F.col(c).alias("v"))
        step = F.log(F.col("n").cast("double")) * (1 / max(1e-3, math.log(100 / self.percent)))
        bands = F.array(2 * F.floor(step), 2 * F.floor(step + 0.5) + 1)  # overlapping, so that no border parts near copies
        near = self.lists.filter(self.tight(F.col("n"), F.col("at"), F.col("n"), F.col("at")))
        if nth == 0:
            near = near.withColumn("root", F.col("gid"))
        else:
            near = near.filter(F.col("df") >= LONG).join(self.placed.filter("cid = gid").select("gid", "root"), "gid")
        near = near.withColumn("band", F.explode(bands))
        first = near.groupBy("tok", "band").agg(F.max_by(F.struct("gid", "n", "at", "root"), rank("gid")).alias("f"))
        near = near.join(first, ["tok", "band"]).filter((F.col("root") != F.col("f.root")) & self.tight(F.col("n"), F.col("at"), F.col("f.n"), F.col("f.at")))
        members = self.placed.join(self.classes.filter("size > 1").select("cid", "core"), "cid")
        inside = members.join(members.groupBy("gid").agg(F.max_by(F.struct("cid", "root"), rank("cid")).alias("f")), "gid").filter("root != f.root")
        self.merge(self.links(near.select(F.col("f.gid").alias("a"), F.col("gid").alias("b")).unionByName(inside.select(F.col("f.cid").alias("a"), F.col("cid").alias("b")))))

    def with_all(self) -> None:
        """Everything whose ends are still apart."""
        of_group = materialize(self.placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")), "spans")
        spread = self.lists.join(of_group, "gid")
        open_ = spread.groupBy("tok").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l != h").select("tok")
        spread = materialize(spread.join(open_, "tok"), "spread")
        x, y = spread.alias("x"), spread.alias("y")
        apart = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))
        pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.gid") < F.col("y.gid")) & apart & self.tight(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
        pairs = pairs.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
        pairs = pairs.unionByName(of_group.filter("low != high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
        side = lambda c: self.placed.select(F.col("gid").alias(f"g{c}"), F.col("cid").alias(c), F.col("root").alias(f"r{c}"))
        self.merge(self.links(pairs.join(side("a"), "ga").join(side("b"), "gb").filter("ra != rb AND (ga != gb OR a < b)").select("a", "b")))


def similarity_components(docs: DataFrame, *, shingle: int = 4, percent: int = 85, sketch_bits: int = SKETCH_BITS, centres: int = CENTRES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, n_class (documents with the same set)."""
    rows, linked = _components(pick(docs, id_col, text_col), shingle, percent, sketch_bits, centres, id_col, text_col)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(linked.join(least, "root").select("cls", "copies", "component_id"), "named")
    out = rows.filter("n > 0").select("doc_id", "n", "cls").join(named, "cls").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("copies").alias("n_class"))
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_class")))


def _components(docs: DataFrame, shingle: int, percent: int, sketch_bits: int, centres: int, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, numbered by rid; and (cls, cid, least, copies, root) of each class: the least
    id and the number of its rows, and one class of its component."""
    levels = shingle_levels(docs, shingle, sketch_bits, text_col)
    rows = materialize(_signatures(docs, levels, shingle, percent, id_col, text_col, keep).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    slim = rows.filter("n > 0")
    classes = slim.groupBy("cls").agg(F.min("rid").alias("cid"), F.min_by(F.struct("doc_id", "hash"), "rid").alias("first"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"))
    classes = materialize(classes.select("cls", "cid", F.col("first.doc_id").alias("doc"), "first.hash", "least", "copies", "grp"), "classes")
    groups = classes.groupBy("grp").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("size"))
    sketches = slim.select(F.col("rid").alias("cid"), "n", "core", "odd")
    members = materialize(classes.select("cid", "doc", "hash", "cls", "grp").join(groups, "grp").drop("grp").join(sketches, "cid"), "members")
    # rows but those that stand for no group, and those are few
    other = materialize(slim.select("rid").join(members.filter("cid = gid").select(F.col("cid").alias("rid")), "rid", "left_anti"), "others")
    each = slim.join(other, "rid", "left_anti").select(F.col("rid").alias("gid"), "n", "core", F.posexplode("toks").alias("at", "tok"))
    shared = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = materialize(each.join(shared, "tok"), "lists")
    join = _Join(docs, members, lists, shingle, percent, id_col, text_col)
    for nth in range(centres):
        join.with_centres(nth)
    join.with_all()
    return rows, materialize(classes.select("cls", "cid", "least", "copies").join(join.placed.select("cid", "root"), "cid"), "final")


def keep_one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with all columns: that of the least id, a null id being the last;
    among rows of that id, one text by a hash, and of equal texts the least by the columns that have an order.

    Rows go by id and the digest of their text, which stay the same however often ``docs`` is read, so rows
    that only share an id with a dropped one, or a null id, are left alone."""
    keys = {"__a": F.xxhash64(docs[text_col]), "__b": F.xxhash64(F.lit(1), docs[text_col])}
    src = docs.select(docs[id_col], docs[text_col], *[c.alias(k) for k, c in keys.items()])
    rows, linked = _components(src, shingle, percent, SKETCH_BITS, CENTRES, id_col, text_col, tuple(keys))
    own = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("__id"), *keys).alias("own")
    placed = materialize(rows.filter("n > 0").select(own, "cls").join(linked.select("cls", "root"), "cls").select("root", "own"), "members")
    first = placed.groupBy("root").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    both = placed.join(materialize(first, "first"), "root")
    # the rows that go; where several have the id and text of the one that stays, all go and one comes back
    gone = both.groupBy("own").agg(F.max(F.col("own") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT stays")
    gone = _sent(materialize(gone.select("own.__id", *[F.col(f"own.{k}") for k in keys], "stays"), "gone"))
    same = lambda d: docs[id_col].eqNullSafe(d["__id"]) & (keys["__a"] == d["__a"]) & (keys["__b"] == d["__b"])
    kept = docs.join(gone, same(gone), "left_anti")
    again = gone.filter("stays")
    if again.isEmpty():
        return kept
    ordered = F.struct(*[docs[c] for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    again = docs.join(again, same(again), "left_semi").select(docs[id_col].alias("__id"), *[c.alias(k) for k, c in keys.items()], F.struct(*[docs[c] for c in docs.columns]).alias("__row"), ordered.alias("__order"))
    return kept.unionByName(again.groupBy("__id", *keys).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*"))


def oracle(shingle: int = 4, percent: int = 85) -> str:
    """``similarity_components`` in DuckDB's SQL, over ``documents``."""
    return f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {shingle - 2}), lambda i: array_to_string(ws[i:i + {shingle - 1}], ' '))) END) AS sh FROM w),
e AS (SELECT r, len(sh) AS n, unnest(sh) AS t FROM s),
l AS (SELECT x.r AS a, y.r AS b FROM e x JOIN e y ON x.t = y.t AND x.r <> y.r AND 100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n
      GROUP BY x.r, y.r HAVING 100 * count(*) >= {percent} * (min(x.n) + min(y.n) - count(*))),
c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id,
       CASE WHEN len(sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY sh) END AS n_class
FROM s JOIN (SELECT c.a, min(s.doc_id) AS component_id FROM c JOIN s ON s.r = c.b GROUP BY c.a) m ON m.a = s.r
"""
