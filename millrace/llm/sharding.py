"""Sharding by balanced label propagation.

Linked documents start in hashed shards, none over its quota.  In each round joins tell every linked
document how much link weight it has in each shard.  So that neighbours don't just swap, only those with a
neighbour of more links may move in even rounds, and half of all, drawn anew, in odd ones.  They ask to move
where they have most, and a shard takes in no more than its quota and those who leave it make room for,
greatest gain first.  Rounds go on until nobody who gains can move, or the weight of cut links has stopped
falling; the labels of the least cut count.
Documents without links then fill every shard up to its quota, so counts end at most one apart.

Nothing is gathered but one number per pair of shards and level of gain.  Ranks are prefix sums over salted parts, so neither a large
shard nor a large group of copies is ever sorted by one task.

Defined results: a null text counts 16 bytes, has the checksum of the empty text and no links; rows are
placed one by one, repeated rows too; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows that a numbering sorts at once, about.
PART = 20_000
#: Rounds in a row without a new least cut after which propagation ends: three even ones, and three odd ones,
#: which hold both halves of a draw.
PATIENCE = 6


def number(df: DataFrame, keys: list[str], n_rows: int, first: Column | None = None) -> DataFrame:
    """Adds ``number``, gapless from 0 within ``keys``, rows of lower ``first`` before others; needs ``nid``."""
    salts = max(1, n_rows // PART)
    part = F.struct((F.lit(0) if first is None else first).cast("long").alias("f"), F.pmod(F.xxhash64("nid", F.lit(7)), F.lit(salts)).alias("s"))
    df = df.withColumn("__part", part)
    counts = df.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("nid")) - 1
    return df.withColumn("__inside", inside).join(offsets, [*keys, "__part"]).withColumn("number", (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__before", "__inside")


def _by_shard(df: DataFrame, k: int) -> list[int]:
    out = [0] * k
    for shard, n in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():  # k rows at most
        out[shard] = n
    return out


def _at(values: list[int], shard: Column) -> Column:
    return F.element_at(F.lit(values), (shard + 1).cast("int"))


def _granted(flows: list[tuple[int, int, int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from shard to shard at once, of flows (from, to, level, rows asking).

    Rings of asks need no room and are granted first.  What is left has no rings, so each shard is settled
    after all those it sends to: it takes in as many as have room or leave, of the highest levels."""
    k, left, got = len(room), {}, {}
    for a, b, _, n in flows:
        out = left.setdefault(a, {})
        out[b] = out.get(b, 0) + n
    open_, settled = set(range(k)), []
    for start in range(k):
        path = [start] if start in open_ else []
        while path:
            b = next((b for b, n in left.get(path[-1], {}).items() if n and b in open_), None)
            if b is None:
                settled.append(path.pop())
                open_.remove(settled[-1])
            elif b in path:
                ring = path[path.index(b) :]
                steps = list(zip(ring, [*ring[1:], b], strict=True))
                n = min(left[x][y] for x, y in steps)
                for x, y in steps:
                    left[x][y] -= n
                    got[x, y] = got.get((x, y), 0) + n
                del path[path.index(b) + 1 :]
            else:
                path.append(b)
    into: dict[int, list] = {}
    had = dict(got)
    for a, b, level, n in sorted(flows, key=lambda f: -f[2]):
        gone = min(n, had.get((a, b), 0))  # granted in rings
        had[a, b] = had.get((a, b), 0) - gone
        into.setdefault(b, []).append((a, n - gone))
    free = list(room)
    for b in settled:
        for a, n in into.get(b, []):
            n = min(n, max(0, free[b]))
            if n:
                got[a, b] = got.get((a, b), 0) + n
                free[b] -= n
                free[a] += n
    return got


def _flows(asks: DataFrame) -> list[tuple[int, int, int, int]]:
    return [tuple(r) for r in asks.groupBy("from", "shard", "level").agg(F.count(F.lit(1)).alias("n")).collect()]


def _fill(nodes: DataFrame, room: list[int], n_rows: int) -> DataFrame:
    """(nid, shard): the nodes, into the room of the shards one after the other."""
    ends, total = [], 0
    for x in room:
        total += x
        ends.append(total)
    return number(nodes, [], n_rows).select("nid", F.size(F.filter(F.lit(ends) if room else F.array(), lambda e: e <= F.col("number"))).cast("int").alias("shard"))


def propagate(nodes: DataFrame, edges: DataFrame, k: int, *, rounds: int | None = None, n_rows: int | None = None) -> DataFrame:
    """nodes: nid (long, distinct), seed (long: nodes of one seed start together); edges: a, b, weight.
    Returns (nid, shard) with shards from 0 to k - 1 whose counts are at most one apart.  Ends by itself, or
    after ``rounds``."""
    n = nodes.count() if n_rows is None else n_rows
    quota = [n // k + (j < n % k) for j in range(k)]
    both = materialize(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).filter("a != b"), "edges")
    linked = nodes.join(both.select(F.col("a").alias("nid")).distinct(), "nid", "left_semi")
    labels = materialize(linked.select("nid", F.pmod(F.xxhash64("seed", F.lit(3)), F.lit(k)).cast("int").alias("shard")), "labels")
    load = _by_shard(labels, k)
    if any(x > q for x, q in zip(load, quota, strict=True)):  # the last of them go where there is room
        ranked = materialize(number(labels, ["shard"], n), "ranked")
        fits = F.col("number") < _at(quota, F.col("shard"))
        over = materialize(ranked.filter(~fits).select("nid"), "over")
        labels = materialize(ranked.filter(fits).select("nid", "shard").unionByName(_fill(over, [max(0, q - x) for q, x in zip(quota, load, strict=True)], n)), "labels")
        load = _by_shard(labels, k)
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    rank = both.join(links.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("top"))
    after = F.col("top") > F.struct("n", (-F.col("a")).alias("b"))
    followers = materialize(links.join(rank, "a").filter(after).select(F.col("a").alias("nid")), "followers")
    asks, least, since, r = None, None, 0, 0
    while rounds is None or r < rounds:
        if asks is None:
            seen = both.join(labels.select(F.col("nid").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.sum("weight").alias("w"))
            best = seen.groupBy("a").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("m"), F.collect_list(F.struct("shard", "w")).alias("all"))
            asks = labels.join(best.select(F.col("a").alias("nid"), "m", "all"), "nid")
            weigh = lambda own: F.aggregate(F.filter("all", lambda x: (x["shard"] == F.col("shard")) == own), F.lit(0.0), lambda t, x: t + x["w"])
            asks = asks.select("nid", F.col("shard").alias("from"), (-F.col("m.s")).cast("int").alias("to"), (F.col("m.w") - weigh(True)).alias("gain"), weigh(False).alias("cut")).filter("cut > 0").withColumnRenamed("to", "shard")
            asks = materialize(asks.withColumn("level", F.least(F.lit(40), F.greatest(F.lit(0), F.floor(F.log2(F.when(F.col("gain") > 0, F.col("gain")))) + 20)).cast("int")), "asks")
            cut = asks.agg(F.sum("cut")).first()[0] or 0.0
        if least is None or cut < least[0]:
            if least is not None and least[1] is not labels:
                discard(least[1])
            least, since = (cut, labels, load), 0
        else:
            since += 1
        if not cut or since == PATIENCE:
            break
        gains = asks.filter("gain > 0")
        drawn = gains.filter(F.pmod(F.xxhash64("nid", F.lit(r // 4)), F.lit(2)) == r // 2 % 2) if r % 2 else gains.join(followers, "nid", "left_semi")
        r += 1
        room = [q - x for q, x in zip(quota, load, strict=True)]
        flows = _flows(drawn)
        granted = _granted(flows, room)
        if not granted:
            if not _granted(_flows(gains), room):
                break
            continue
        if sum(f[3] for f in flows) > sum(granted.values()):
            most = F.split(F.lit(",".join(str(granted.get((a, b), 0)) for a in range(k) for b in range(k))), ",").cast("array<bigint>")
            drawn = number(drawn, ["from", "shard"], n, 40 - F.col("level")).filter(F.col("number") < F.element_at(most, F.col("from") * k + F.col("shard") + 1))
        moved = drawn.select("nid", F.col("shard").alias("__to"))
        before, labels = labels, materialize(labels.join(moved, "nid", "left").select("nid", F.coalesce("__to", "shard").alias("shard")), "labels")
        if before is not least[1]:
            discard(before)
        discard(asks)
        asks, load = None, [x + sum(granted.get((a, b), 0) - granted.get((b, a), 0) for a in range(k)) for b, x in enumerate(load)]
    if least is not None and r != rounds:
        _, labels, load = least
    free = materialize(nodes.select("nid").join(labels, "nid", "left_anti"), "free")
    return labels.unionByName(_fill(free, [q - x for q, x in zip(quota, load, strict=True)], n))


def copy_links(rows: DataFrame, cap: int, n_rows: int) -> DataFrame:
    """(a, b, weight) that link each row to the first of its group, in pieces of ``cap`` rows at most.

    rows: nid, h1, h2; a group is rows of equal h1, h2.
    """
    groups = rows.groupBy("h1", "h2").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = materialize(groups, "groups")  # so that the join starts from plain exchanges, whose large partitions can be split
    members = materialize(rows.select("nid", "h1", "h2").join(groups, ["h1", "h2"]).select("nid", "head", "copies"), "members")
    weight = F.when(8 * F.col("copies") <= cap, 2.0).otherwise(1.0).alias("weight")
    small = members.filter(F.col("copies") <= cap).select("nid", "head", F.lit(0).cast("long").alias("piece"), weight)
    large = number(members.filter(F.col("copies") > cap), ["head"], n_rows).select("nid", "head", F.floor(F.col("number") / cap).alias("piece"), weight)
    pieces = materialize(small.unionByName(large), "pieces")
    firsts = pieces.groupBy("head", "piece").agg(F.min("nid").alias("b"))
    # small groups weigh more: they go first where room is short, as a large one can be spread anyway
    return pieces.join(firsts, ["head", "piece"]).select(F.col("nid").alias("a"), "b", "weight")


def shard_documents(docs: DataFrame, k: int, *, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), linked by equal texts."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("h2"))
    rows = materialize(rows.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    n = rows.count()
    links = copy_links(rows.filter(F.col("h1").isNotNull()), max(1, n // k), n)
    placed = propagate(rows.select("nid", F.col("nid").alias("seed")), links, k, rounds=rounds, n_rows=n)
    placed = number(materialize(placed, "placed"), ["shard"], n)
    out = rows.join(placed, "nid")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
