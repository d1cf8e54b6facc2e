"""Prefix trie of conversations; totals of all subtrees by parallel tree contraction.

A node is a depth and the exclusive or of 120-bit digests of the turns before it, each taken with its place, so that the
nodes of a conversation come from a running aggregate and a parent's name is its child's without the child's turn. Turns
are placed by ranges and the running aggregate works in stretches of a conversation: no conversation is gathered in a task.

Contraction alternates two steps on the tree of living nodes until only roots are left. Rake: all leaves go, and add
their totals to their parents, a partial aggregate. Compress: the nodes of a chain, which have a single child each, double
their pointers downwards in join rounds until every one points to the end of its chain with the weight of what it passes;
the end is hung under what the chain hung on and carries that weight. Both steps leave at most half of the leaves, so
there are as many rounds as the logarithm of the tree's leaves, however deep or wide the tree is. Expansion goes back
through the rounds: a raked node's total was final, a chain's node adds its weight to the total of the chain's end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgrain.llm.common import saved
from pressgrain.llm.ranks import ranked

STRETCH, PIECE = 1024, 4096
ROOT = "0:0:0"


def subtree_totals(nodes: DataFrame, values: Sequence[str], id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """`id_col` and, for each of `values` (non-null long columns), its sum over the node and all nodes below.

    `nodes` is a forest: one row per id, roots have a null parent. A node whose parent is missing counts as a root. Repeated
    ids and circles are errors of the caller. An empty table gives no rows.
    """
    own = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), *values)
    kids = own.groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("kids"))
    known = own.select(F.col("id").alias("above"))
    alive = own.join(known, F.col("parent") == F.col("above"), "left").drop("parent").withColumnRenamed("above", "parent")
    alive = alive.join(kids, F.col("id") == F.col("up"), "left").select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *(F.lit(0).cast("long").alias(f"carry_{v}") for v in values))
    alive, final, chains = saved(alive, "alive"), [], []
    while alive.take(1):
        leaves = alive.where("kids = 0")
        final.append(saved(leaves.select("id", *values), "raked"))
        alive = saved(_raked(alive.where("kids > 0"), leaves, values), "alive")
        single = alive.where("kids = 1 AND parent IS NOT NULL")
        if single.take(1):
            chain, alive = _compressed(alive, single, values)
            chains.append(chain)
    totals = final[0] if final else own.select("id", *values)
    for more in final[1:]:
        totals = totals.unionByName(more)
    for chain in reversed(chains):  # the end of a chain was raked later, or is part of a chain of a later round
        found = chain.join(totals.withColumnRenamed("id", "__id"), F.col("end") == F.col("__id"))
        found = saved(found.select(F.col("node").alias("id"), *((F.col(f"w_{v}") + F.col(v)).alias(v) for v in values)), "expanded")
        totals = totals.unionByName(found)
    return totals.withColumnRenamed("id", id_col)


def _raked(inner: DataFrame, leaves: DataFrame, values: Sequence[str]) -> DataFrame:
    """Nodes with children, after all leaves among these have given them their totals and gone."""
    given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("up")).agg(F.count(F.lit(1)).alias("gone"), *(F.sum(F.col(v) + F.col(f"carry_{v}")).alias(f"got_{v}") for v in values))
    joined = inner.join(given, F.col("id") == F.col("up"), "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("id", "parent", (F.col("kids") - more("gone")).alias("kids"), *((F.col(v) + more(f"got_{v}")).alias(v) for v in values), *(f"carry_{v}" for v in values))


def _compressed(alive: DataFrame, single: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Every chain node with the end of its chain and the weight from itself to there, and the tree without these nodes."""
    below = alive.where("parent IS NOT NULL").select(F.col("id").alias("end"), F.col("parent").alias("up"), *(F.col(f"carry_{v}").alias(f"c_{v}") for v in values))
    jumps = single.join(below, F.col("id") == F.col("up"))
    jumps = saved(jumps.select(F.col("id").alias("node"), "end", *((F.col(v) + F.col(f"c_{v}")).alias(f"w_{v}") for v in values)), "jumps")
    done, open_ = [], jumps
    while True:
        # Those that point to a node of their chain go on to where that one points.
        ahead = jumps.select(F.col("node").alias("next"), F.col("end").alias("far"), *(F.col(f"w_{v}").alias(f"f_{v}") for v in values))
        met = saved(open_.join(ahead, F.col("end") == F.col("next"), "left"), "jumps")
        done.append(met.where("next IS NULL").select("node", "end", *(f"w_{v}" for v in values)))
        open_ = met.where("next IS NOT NULL").select("node", F.col("far").alias("end"), *((F.col(f"w_{v}") + F.col(f"f_{v}")).alias(f"w_{v}") for v in values))
        if not open_.take(1):
            break
        jumps = done[0]
        for more in [*done[1:], open_]:
            jumps = jumps.unionByName(more)
    chain = done[0]
    for more in done[1:]:
        chain = chain.unionByName(more)
    gone = single.select(F.col("id").alias("gone"))
    # The topmost node of a chain hangs on a node that stays; so from now on does the chain's end.
    tops = single.join(gone, F.col("parent") == F.col("gone"), "left_anti").select(F.col("id").alias("top"), F.col("parent").alias("to"), *(F.col(f"carry_{v}").alias(f"t_{v}") for v in values))
    hung = tops.join(chain, F.col("top") == F.col("node")).select("end", "to", *((F.col(f"w_{v}") + F.col(f"t_{v}")).alias(f"t_{v}") for v in values))
    rest = alive.join(gone, F.col("id") == F.col("gone"), "left_anti").join(hung, F.col("id") == F.col("end"), "left")
    # The weight up to the end holds what the end carried before.
    carry = (F.when(F.col("end").isNull(), F.col(f"carry_{v}")).otherwise(F.col(f"t_{v}")).alias(f"carry_{v}") for v in values)
    return chain, saved(rest.select("id", F.when(F.col("end").isNull(), F.col("parent")).otherwise(F.col("to")).alias("parent"), "kids", *values, *carry), "alive")


def _digest(*parts: Column) -> Column:
    """Two 60-bit numbers of a row's SHA-256."""
    hexed = F.sha2(F.concat_ws("", *(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)
    return F.struct(F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long").alias("a"), F.conv(F.substring(hexed, 16, 15), 16, 10).cast("long").alias("b"))


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv`, `place` (from 0), `n` (turns of the conversation), `mark` (digest of role and text), `n_words` of each turn.

    Turns ascend, null turns first, and of equal ones by role and text. A null role or text counts as empty. Rows without
    a conversation are left out.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    own = turns.where(turns[conv_col].isNotNull()).select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), role.alias("role"), F.sha2(text, 256).alias("order"), mark.alias("mark"), words.alias("n_words"))
    return ranked(saved(own, "turns"), "conv", ["turn", "role", "order"]).select("conv", "place", "n", "mark", "n_words")


def rebuilt(turns: DataFrame, step: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: (turns, conversations).

    Conversation c begins with the first h turns of conversation c - c % step (all if it has fewer, none if it is absent)
    and goes on with its own turns after its first h; h is the CRC-32 of c in decimal modulo `most`. `turns` come from
    `placed_turns`. Turns have `conv`, `place`, `mark`, `n_words`; conversations have `conv`, `n` (turns, possibly 0).
    """
    sizes = saved(turns.groupBy("conv").agg(F.first("n").alias("own")), "sizes")
    base, head = F.col("conv") - F.col("conv") % step, F.crc32(F.col("conv").cast("string")) % most
    asked = sizes.select("conv", "own", base.alias("base"), head.alias("h"))
    asked = asked.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    asked = saved(asked.withColumn("got", F.least("h", F.coalesce("there", F.lit(0)))), "asked")
    begin = turns.where(F.col("place") < most - 1).select(F.col("conv").alias("base"), "place", "mark", "n_words")
    begin = asked.where("got > 0").select("conv", "base", "got").join(begin, "base").where("place < got").select("conv", "place", "mark", "n_words")
    rest = turns.join(asked.select("conv", "h", "got"), "conv").where("place >= h")
    rest = rest.select("conv", (F.col("place") - F.col("h") + F.col("got")).alias("place"), "mark", "n_words")
    return begin.unionByName(rest), asked.select("conv", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """`conv`, `depth`, `node`, `parent`, `n_words` (of the last turn) for every non-empty prefix of every conversation."""
    hashed = turns.withColumn("h", _digest(F.col("place").cast("string"), F.col("mark"))).select("conv", "place", "n_words", "h.a", "h.b", F.floor(F.col("place") / STRETCH).alias("stretch"))
    hashed = saved(hashed, "marks")
    sums = hashed.groupBy("conv", "stretch").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "stretch", *(F.coalesce(F.bit_xor(f"s{x}").over(before), F.lit(0)).alias(f"s{x}") for x in "ab"))
    inside = Window.partitionBy("conv", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.withColumns({f"r{x}": F.bit_xor(x).over(inside) for x in "ab"}).join(sums, ["conv", "stretch"])
    upto = [F.col(f"r{x}").bitwiseXOR(F.col(f"s{x}")) for x in "ab"]
    name = lambda depth, a, b: F.concat_ws(":", depth.cast("string"), a.cast("string"), b.cast("string"))
    depth = F.col("place") + 1
    return run.select("conv", depth.alias("depth"), name(depth, *upto).alias("node"), name(F.col("place"), upto[0].bitwiseXOR(F.col("a")), upto[1].bitwiseXOR(F.col("b"))).alias("parent"), "n_words")


def _joined_digests(ends: DataFrame) -> DataFrame:
    """`node`, `ends_sha256`: digest of the decimal ids of the conversations that end there, ascending, joined by commas.

    Ids are put together in pieces where they stand in order; the digest then reads a node's pieces one after another.
    """
    placed = ranked(saved(ends, "ends"), "node", ["conv"]).select("node", "conv", "place", F.floor(F.col("place") / PIECE).alias("piece"))
    pieces = placed.groupBy("node", "piece").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        def out(node, state):
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

        now, state = None, None
        for batch in batches:
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != now:
                    if state:
                        yield out(now, state)
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield out(now, state)

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(run, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of conversations: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`,
    `n_children`, `n_leaves` (childless nodes of its subtree), `saved_tokens` (sum over its subtree of the words of the last
    turn, once for each member but one), `ends_sha256` (of the members that end there).

    `turns` have `conv`, `place`, `mark`, `n_words`; `conversations` have `conv` and `n`, one row each, also without turns.
    The root has depth 0 and all conversations as members; without conversations there is no node.
    """
    own = saved(prefixes(turns), "prefixes")
    counted = own.groupBy("node").agg(F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.first("n_words").alias("n_words"))
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_words"))
    nodes = counted.select("node", "conv_id", F.col("depth").cast("long").alias("depth"), "parent", "n_convs", "n_words").unionByName(root)
    kids = counted.groupBy(F.col("parent").alias("above")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, F.col("node") == F.col("above"), "left").drop("above").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = saved(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")}), "trie")
    totals = subtree_totals(nodes, ["n_leaves", "saved_tokens"], "node", "parent")
    last = own.join(conversations.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("node", "conv")
    ends = _joined_digests(last.unionByName(conversations.where("n = 0").select(F.lit(ROOT).alias("node"), "conv")))
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, "node", "left").join(up, "parent", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
