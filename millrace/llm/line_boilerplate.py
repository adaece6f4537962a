"""Line dedup relative to a site: lines that stand on too large a share of a host's pages are dropped.

DataFrame functions only.  Each page sends the digests of its distinct lines, summed map-side, so a host
with a third of all pages costs no more than its distinct lines.  A host can have no more boilerplate
lines than its mean number of lines per page divided by the ratio, so the digests of a host fit one row;
those rows are written first, and Catalyst then knows their size and sends them to the pages only if they
are small, else both sides are shuffled by host and split where a host is large.

Defined results: a null text stays null, with no lines.  Blank lines are never dropped.  A null host is a
host of its own.  Every row is a page, repeated rows too.  An empty table gives an empty result.  A line is
dropped if it stands on more than ``max_percent`` of the host's pages, and on ``min_count`` pages at least,
and the host has ``min_pages`` at least: with fewer, a share says little, and two copies of one page would
make boilerplate of all its lines.  So by default a line on 9 of 9 pages or 3 of 12 stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

NEWLINE = "\n"


def _digest(line: Column) -> Column:
    """128 bits of a line, as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", max_percent: int = 8, min_count: int = 4, min_pages: int = 10) -> DataFrame:
    """(host, lines): the digests of the lines that more than ``max_percent`` of the host's pages contain."""
    pages = docs.select(docs[host_col].alias("host"), docs[text_col].alias("text"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", NEWLINE, -1))).alias("line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    counts = lines.select("host", _digest(F.col("line")).alias("d")).groupBy("host", F.col("d.a").alias("a"), F.col("d.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= min_count).alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    often = often.filter((F.col("pages") >= min_pages) & (100 * F.col("n") > max_percent * F.col("pages")))
    return often.groupBy(F.col("c.host").alias("host")).agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def drop_boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", max_percent: int = 8, min_count: int = 4, min_pages: int = 10, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns in ``keep``, then ``n_lines``, ``n_dropped`` and ``text`` without the dropped lines."""
    bad = materialize(boilerplate_lines(docs, host_col=host_col, text_col=text_col, max_percent=max_percent, min_count=min_count, min_pages=min_pages), "boilerplate")
    bad = bad.select(F.col("host").alias("__host"), F.col("lines").alias("__bad"))
    own = [docs[c] for c in keep if c != text_col]
    src = docs.select(*own, docs[host_col].alias("__own_host"), docs[text_col].alias("__text"))
    both = src.join(bad, F.col("__own_host").eqNullSafe(F.col("__host")), "left")
    split = F.split("__text", NEWLINE, -1)
    left = F.when(F.col("__bad").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("__bad", _digest(x))))
    both = both.withColumn("__lines", split).withColumn("__left", left)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return both.select(
        *[F.col(c) for c in keep if c != text_col],
        size("__lines").alias("n_lines"),
        (size("__lines") - size("__left")).alias("n_dropped"),
        F.when(F.col("__bad").isNull(), F.col("__text")).otherwise(F.array_join("__left", NEWLINE)).alias("text"),
    )


def oracle(max_percent: int = 8, min_count: int = 4, min_pages: int = 10) -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
x AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
b AS (SELECT x.source, list(line) AS bad FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source
      WHERE n >= {min_count} AND pages >= {min_pages} AND 100 * n > {max_percent} * pages GROUP BY x.source),
y AS (SELECT doc_id, d.source, ls, list_filter(ls, lambda l: NOT coalesce(list_contains(bad, l), false)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN ls IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM y
"""
