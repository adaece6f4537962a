r"""Chat formatting over reply trees, with DataFrame functions only.

Each message names its parent.  Root-to-leaf paths are enumerated by iterative self-joins that double the
distance climbed in each round, so a path of n messages takes log2(n) rounds.  A first climb carries sums of
scores only, one row for each message; by these leaves are ranked.  Then the chosen paths alone are enumerated,
their texts joined, and each is formatted as one conversation, which is one row and has to fit a task.

Template of a turn: ``### role\n``, the text, ``</turn>\n``.  In roles and texts each backslash is doubled
and the control strings get one: ``</turn>`` becomes ``<\/turn>``, ``### `` becomes ``\### ``, a line end in
a role gets one before it.  A backslash and the character after it stand for that character, so reading back is exact.
The loss mask lists, in code points, the start and length of each trained turn's text.

Defined results: null roles and texts are empty; a message whose parent is null or missing is a root;
messages on a cycle have no path; repeated rows must have node numbers of their own (``chain`` gives them);
a null conversation id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

END = "</turn>\n"
HEAD = r"^### ([^\\\n]*(?:\\[\s\S][^\\\n]*)*)\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("### "), F.lit("\\### "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as trees: each row's parent is the row before it by turn (ties: by role, text)."""
    df = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("__turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("__turn").asc_nulls_first(), "role", "text")).cast("long")
    return df.select("conv_id", node.alias("node"), (node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str, node: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{node}") == F.col(f"{b}.node"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of (conv_id, node, to, total, scored), one row for each message, for 1, 2, 4, ... steps up: ``to`` is the
    ancestor that many steps up (null: the path ends below it), ``total`` and ``scored`` the sum and number of the scores
    that are passed on the way, the message's own included.  Only messages on or below a cycle never come to null."""
    ids = nodes.select("conv_id", "node")
    has = nodes.alias("a").join(ids.alias("b"), _same("a", "b", "parent"), "left_semi").select("conv_id", "node", F.col("parent").alias("to"), "score")
    root = nodes.alias("a").join(has.alias("b"), _same("a", "b", "node"), "left_anti").select("conv_id", "node", F.lit(None).cast("long").alias("to"), "score")
    own = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.col("score").isNotNull().cast("long").alias("scored")
    levels = [materialize(has.unionByName(root).select("conv_id", "node", "to", *own), "climb")]
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << (len(levels) - 1) < most and not levels[-1].filter(F.col("to").isNotNull()).isEmpty():
        at = levels[-1]
        further = at.filter(F.col("to").isNotNull()).alias("a").join(at.alias("b"), _same("a", "b", "to"))
        further = further.select("a.conv_id", "a.node", "b.to", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.scored") + F.col("b.scored")).alias("scored"))
        levels.append(materialize(further.unionByName(at.filter(F.col("to").isNull())), "climb"))
    return levels


def chosen_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, path_rank, path_score, node, up): each message on the ``branches`` best paths of a conversation (None:
    on all), ``up`` steps above its leaf.  Leaves are ranked before paths are enumerated, so other paths make no rows."""
    levels = climb(nodes)
    parents = levels[0].filter(F.col("to").isNotNull()).select("conv_id", F.col("to").alias("node")).distinct()
    leaves = levels[-1].filter(F.col("to").isNull()).alias("a").join(parents.alias("b"), _same("a", "b", "node"), "left_anti")
    leaves = leaves.select("conv_id", F.col("node").alias("leaf"), F.when(F.col("scored") > 0, F.col("total") / F.col("scored")).alias("path_score"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("path_score").desc_nulls_last(), "leaf"))
    best = leaves.withColumn("path_rank", rank)
    if branches is not None:
        best = best.filter(F.col("path_rank") <= branches)
    reach = materialize(best.select("conv_id", "leaf", "path_rank", "path_score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")), "reach")
    for k, level in enumerate(levels[:-1]):  # on the last one all paths of these leaves have ended
        step = level.filter(F.col("to").isNotNull()).alias("b")
        further = reach.alias("r").join(step, _same("r", "b", "node"))
        reach = materialize(reach.unionByName(further.select("r.conv_id", "r.leaf", "r.path_rank", "r.path_score", F.col("b.to").alias("node"), (F.col("r.up") + (1 << k)).alias("up"))), "reach")
    return reach


def format_reply_trees(nodes: DataFrame, *, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """nodes: conv_id, node, parent, role, text, score.  One row for each chosen path:
    conv_id, leaf, path_rank, path_score (mean), formatted, loss_mask (array of start, length)."""
    nodes = materialize(nodes, "messages")
    paths = chosen_paths(nodes.select("conv_id", "node", "parent", "score"), branches)
    on = paths.alias("p").join(nodes.alias("n"), _same("p", "n", "node")).select("p.conv_id", "p.leaf", "p.path_rank", "p.path_score", "p.up", "n.role", "n.text")
    head = F.concat(F.lit("### "), F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    on = on.select("conv_id", "leaf", "path_rank", "path_score", "up", (F.col("role") == trained).alias("__on"), head.alias("__head"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("__body"))
    on = on.withColumn("__turn", F.concat("__head", "__body", F.lit(END)))
    before = F.sum(F.length("__turn")).over(Window.partitionBy("conv_id", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1))
    span = F.struct((F.coalesce(before, F.lit(0)) + F.length("__head")).cast("long").alias("start"), F.length("__body").cast("long").alias("length"))
    on = on.withColumn("__span", F.when(F.col("__on"), span))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.col("__turn").alias("turn"), F.col("__span").alias("span"))))
    whole = on.groupBy("conv_id", "leaf").agg(F.first("path_rank").alias("path_rank"), F.first("path_score").alias("path_score"), turns.alias("__turns"))
    return whole.select(
        "conv_id", "leaf", "path_rank", "path_score",
        F.array_join(F.transform("__turns", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("__turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in ``formatted`` and under ``loss_mask``: adds turns (role, text) and loss_text."""
    parts = F.slice(F.split("formatted", END, -1), F.lit(1), F.size(F.split("formatted", END, -1)) - 1)
    turn = lambda x: F.struct(unescape(F.regexp_extract(x, HEAD, 1)).alias("role"), unescape(F.regexp_replace(x, HEAD, "")).alias("text"))
    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(loss, ""))


def oracle() -> str:
    """The digests that op10 reads back, in DuckDB's SQL over ``conversations``."""
    esc = r"replace(replace(replace({}, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### ')"
    text, role = esc.format("text"), "replace(" + esc.format("role") + r", chr(10), '\' || chr(10))"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        sum(4 + length({role}) + 1 + length({text}) + 8) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
