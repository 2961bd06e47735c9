"""Reply trees to conversations: paths by iterative self-joins, best branch, one reversible template.

A message names its parent; a leaf and its ancestors are a branch. Ancestors are
found by pointer doubling: each round joins every message's 2**k-th ancestor to
that one's own, with the scores in between summed, until it has reached the root;
so the number of joins is the logarithm of the depth and a round's rows are the
messages that lie deeper than the steps taken. The same
tables lay out the chosen branches. All work is DataFrame expressions, on ids
until the branches are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.store import materialize

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"


def escape(text: Column) -> Column:
    """Make every control mark impossible inside the text, reversibly: each starts with ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def chain_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A tree table of linear conversations: each row answers the one before it by turn.

    node and parent number the rows of a conversation from 0. Equal or null
    turns keep an order by role and by the text's MD5, null turns first.
    """
    tie = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), "role", "text", tie.alias("_tie"))
    at = W.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "role", "_tie")
    node = (F.row_number().over(at) - 1).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def _same(conv: str, node: str, other_conv: str, other_node: str) -> Column:
    return F.col(conv).eqNullSafe(F.col(other_conv)) & (F.col(node) == F.col(other_node))


class Reach:
    """Pointer doubling over a tree's messages: ``steps[k]`` takes (jc, jn) to its 2**k-th ancestor ``far``.

    ``whole`` holds the messages that reach a root: conv_id, node, whether it is
    a leaf among them, and the summed score of its branch.
    """

    def __init__(self, tree: DataFrame) -> None:
        score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in tree.columns else F.lit(1.0)
        rows = tree.select("conv_id", "node", F.struct("parent").alias("p"), score.alias("s")).filter("node is not null")
        nodes = rows.groupBy("conv_id", "node").agg(F.min("p")["parent"].alias("parent"), F.min("s").alias("score"))
        known = nodes.select(F.col("conv_id").alias("kc"), F.col("node").alias("kn"))
        nodes = nodes.join(known, _same("conv_id", "parent", "kc", "kn"), "left")
        now = materialize(nodes.select("conv_id", "node", F.col("kn").alias("to"), "score"), "reach")
        most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        self.parents, done = now, []
        self.steps = []
        while not now.filter("to is not null").isEmpty() and 2 ** len(self.steps) <= most:
            far = now
            for part in done:
                far = far.unionByName(part)
            far = far.select(F.col("conv_id").alias("jc"), F.col("node").alias("jn"), F.col("to").alias("far"), F.col("score").alias("more"))
            done.append(now.filter("to is null"))
            going = now.filter("to is not null")
            self.steps.append(going.select(F.col("conv_id").alias("jc"), F.col("node").alias("jn"), F.col("to").alias("far")))
            going = going.join(far, _same("conv_id", "to", "jc", "jn"))
            now = materialize(going.select("conv_id", "node", F.col("far").alias("to"), (F.col("score") + F.col("more")).alias("score")), "reach")
        # whoever still has an ancestor, further up than the conversation has messages, is on a cycle or below one
        inner = self.parents.filter("to is not null").select(F.col("conv_id").alias("kc"), F.col("to").alias("kn"), F.lit(False).alias("leaf")).distinct()
        whole = now.filter("to is null")
        for part in done:
            whole = whole.unionByName(part)
        whole = whole.join(inner, _same("conv_id", "node", "kc", "kn"), "left")
        self.whole = whole.select("conv_id", "node", "score", F.coalesce("leaf", F.lit(True)).alias("leaf"))

    def paths(self, leaves: DataFrame) -> DataFrame:
        """(conv_id, leaf, node, up): every message from the given (conv_id, leaf) rows up to the root."""
        paths = leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
        for k, step in enumerate(self.steps):
            further = paths.join(step, _same("conv_id", "node", "jc", "jn"))
            further = further.select("conv_id", "leaf", F.col("far").alias("node"), (F.col("up") + 2**k).alias("up"))
            paths = materialize(paths.unionByName(further), "paths")
        return paths


def branches(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): every message of every root-to-leaf path, ``up`` steps above its leaf.

    A parent that doesn't exist makes its message a root. Messages on a cycle and
    below one reach no root: they belong to no branch. Rows without a node are
    left out. Of repeated (conv_id, node) rows the least parent, none before
    any, and the least score count.
    """
    reach = Reach(tree)
    return reach.paths(reach.whole.filter("leaf").select("conv_id", F.col("node").alias("leaf")))


def _best(reach: Reach, top: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "node"))
    best = reach.whole.filter("leaf").withColumn("branch_rank", rank).filter(F.col("branch_rank") <= top)
    return best.select("conv_id", F.col("node").alias("leaf"), "branch_rank", F.col("score").alias("branch_score"))


def best_branches(tree: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` leaves per conversation by summed score (a ``score`` column; none counts 1 a message).

    Equal scores go to the smaller leaf. Returns (conv_id, leaf, branch_rank, branch_score).
    """
    return _best(Reach(tree), top)


def format_branches(tree: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, branch_rank, branch_score, formatted, loss_mask) of the best reply paths.

    ``tree``: conv_id, node, parent, role, text and optionally score. A turn is
    written ``<|turn|>role<|body|>text<|end|>`` with role and text escaped.
    loss_mask lists the assistant bodies as (start, length) in code points of
    the formatted string. Null roles and texts count as empty; of repeated
    (conv_id, node) rows the least role and text is said. A conversation without
    a branch (all on cycles) has no row.

    The branches are found and ranked on ids alone; only the chosen ones are
    laid out, and texts are shuffled once, by conversation.
    """
    reach = Reach(tree)
    chosen = materialize(_best(reach, top), "chosen")
    paths = reach.paths(chosen).select(F.col("conv_id").alias("pc"), F.col("leaf").alias("pl"), "node", "up")
    chosen = chosen.join(paths, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("leaf") == F.col("pl")))
    said = F.struct("node", F.lit(1).alias("side"), F.lit(0).cast("long").alias("up"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    asked = F.struct("node", F.lit(0).alias("side"), "up", F.lit("").alias("role"), F.lit("").alias("text"))
    texts = tree.groupBy(F.col("conv_id").alias("tc")).agg(F.collect_list(said).alias("said"))
    wanted = chosen.groupBy("conv_id", "branch_rank", "branch_score").agg(F.collect_list(asked).alias("asked"))
    both = wanted.join(texts, F.col("conv_id").eqNullSafe(F.col("tc"))).select(
        "conv_id", "branch_rank", "branch_score", F.sort_array(F.concat("asked", "said")).alias("rows")
    )
    # a wanted message is followed by what it says
    before = lambda i: F.get("rows", i - 1)
    found = F.transform("rows", lambda x, i: F.when((x["side"] == 1) & (before(i)["side"] == 0) & (before(i)["node"] == x["node"]), F.struct(
        (-before(i)["up"]).alias("at"), x["role"].alias("role"), x["text"].alias("text")
    )))
    one = both.withColumn("_turns", F.sort_array(F.filter(found, lambda t: t.isNotNull())))

    def written(t: Column) -> Column:
        head, body = F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)), escape(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("skip"), F.length(body).alias("len"), (t["role"] == "assistant").alias("loss")
        )

    one = one.withColumn("turns", F.transform("_turns", written))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    mask = F.aggregate(
        "turns",
        zero,
        lambda s, t: F.struct(
            (s["pos"] + F.length(t["piece"])).alias("pos"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["pos"] + t["skip"]).alias("start"), t["len"].alias("length")))))
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return one.select("conv_id", "branch_rank", "branch_score", text.alias("formatted"), mask.alias("loss_mask"))


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        both = F.split(F.regexp_replace(p, r"<\|end\|>$", ""), r"<\|body\|>")
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
