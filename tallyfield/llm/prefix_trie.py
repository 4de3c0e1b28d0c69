"""Prefix trie of conversations: one ROLLUP over positional columns of turn digests makes all nodes.

A conversation becomes rows of ``WIDTH`` turn columns: block 0 has its first turns, block 1 the next ones,
and so on; every block carries the digest of the node at which the block before it ended.  GROUP BY block,
that node, ROLLUP (t1, ..., t8) then makes every prefix of every conversation a group, however long they
are; grouping_id tells how many columns of a block a group names.  Nodes are told apart by 128 bits: the
exclusive or of hashes of (place, role, text), so a block's own is known without the blocks before it.

Sums over subtrees need no walk through levels.  A node's smallest member is also the smallest of every node
below it on its own conversation, so each node is one row of one conversation, and what a subtree's nodes
add up to is what its members' own rows add up to, less the rows of the smallest one above the node: a
second ROLLUP.  Hot groups (a common first turn, copies of one conversation) are counted before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.llm.common import stash
from tallyfield.llm.turns import hashed, in_order, turn_key

#: Turn columns of a block.
WIDTH = 8
#: At most so many turns are taken from the family's first conversation, and so many ids are a family.
HEADS = 4
FAMILY = 20
WORD = "[^\\x20\\x09-\\x0D]+"
#: Conversation ids in one part of a node's list, as a power of two.
PART_BITS = 10
NODE = ["depth", "na", "nb"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, a and b (120 bits of role and text), words.  Null role or text is empty; see ``prefix_trie``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_key(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    half = lambda at: F.conv(F.substring("key", at, 15), 16, 10).cast("long")
    return in_order(rows, "key").select("conv_id", "pos", half(1).alias("a"), half(17).alias("b"), "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation's turns once its first h are those of its family's first conversation.

    Gives the turns (conv_id, pos, a, b, words) and the conversations with their new length (conv_id, size),
    those without a turn among them.  h is crc32 of the id, modulo ``HEADS``.
    """
    family = lambda c: F.col(c) - F.col(c) % FAMILY
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", family("conv_id").alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    first = convs.where("conv_id = base").select("base", F.col("own").alias("there"))
    # at most two families' ids meet one row here (ids on either side of 0 share family 0)
    convs = stash(convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    lent = convs.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken").cast("long"))).alias("pos")).join(heads, ["base", "pos"])
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    cols = ["conv_id", F.col("pos").cast("long").alias("pos"), "a", "b", "words"]
    return lent.select(cols).unionByName(own.select(cols)), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))


def blocks(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, block, pa and pb (node before the block), n, xa, xb (the block's own), t1.. (za, zb, words)."""
    at = F.col("pos") - 1
    tagged = turns.select("conv_id", F.floor(at / width).alias("block"), (at % width + 1).alias("j"), F.struct(F.xxhash64("pos", "a", "b").alias("za"), F.xxhash64("b", "pos", "a").alias("zb"), "words").alias("t"))
    columns = [F.max(F.when(F.col("j") == i, F.col("t"))).alias(f"t{i}") for i in range(1, width + 1)]
    wide = tagged.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.bit_xor("t.za").alias("xa"), F.bit_xor("t.zb").alias("xb"), *columns)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long"))
    wide = wide.withColumns({"pa": before("xa"), "pb": before("xb")})
    none = convs.where("size = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("block", "n", "xa", "xb", "pa", "pb")])
    return wide.unionByName(none, allowMissingColumns=True)


def rolled(wide: DataFrame, width: int = WIDTH, **sums: str) -> DataFrame:
    """All prefixes of the blocks: depth, na, nb, pna, pnb (the node above), words of the last turn, and sums."""
    names = [f"t{i}" for i in range(1, width + 1)]
    asked = "".join(f", {expr} AS {name}" for name, expr in sums.items())
    rows = wide.sparkSession.sql(f"SELECT block, pa, pb, {', '.join(names)}, grouping_id() AS level{asked} FROM {{wide}} GROUP BY block, pa, pb, ROLLUP ({', '.join(names)})", wide=wide)
    # the columns that a group doesn't name are the ones set in grouping_id
    rows = rows.withColumn("j", width - F.bit_count("level")).withColumn("last", F.get(F.array(*names), F.col("j") - 1))
    rows = rows.where("(j > 0 and last is not null) or (j = 0 and block = 0)")

    def node(part: str, base: str, upto: int) -> Column:
        out = F.col(base)
        for i, name in enumerate(names, 1):
            seen = F.col(f"{name}.{part}") if upto == 0 else F.when(F.col("j") > i, F.col(f"{name}.{part}"))
            out = out.bitwiseXOR(F.coalesce(seen, F.lit(0).cast("long")))
        return out

    words = F.coalesce("last.words", F.lit(0).cast("long")).alias("words")
    above = [F.when(F.col("block") * width + F.col("j") > 0, node(p, b, 1)).alias(n) for p, b, n in (("za", "pa", "pna"), ("zb", "pb", "pnb"))]
    return rows.select((F.col("block") * width + F.col("j")).alias("depth"), node("za", "pa", 0).alias("na"), node("zb", "pb", 0).alias("nb"), *above, words, *sums)


def ends(wide: DataFrame) -> DataFrame:
    """depth, na, nb, digest: SHA-256 of the ids of the conversations that end at a node, in order, with commas."""
    last = wide.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("xa").alias("na"), F.bit_xor("xb").alias("nb"))
    # a part has at most 1,024 ids, since a conversation ends at one node
    parts = last.groupBy(*NODE, F.shiftright("conv_id", PART_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return hashed(parts, NODE, ["part"], "ids", ",")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are taken by turn, nulls first, those of one number by the digest of role and text; null role or
    text is empty.  Rows without a conv_id belong to no conversation: they can be no member and are left out.
    Repeated rows are turns of their own.  No conversations, no nodes; a conversation without turns ends at
    the root.  Other columns of the table aren't read.
    """
    turns, convs = rebuilt(stash(turn_digests(conversations)))
    wide = stash(blocks(turns, convs))
    nodes = stash(rolled(wide, n_convs="count(*)", conv_id="min(conv_id)"))
    up = {"depth": F.col("depth") - 1, "na": F.col("pna"), "nb": F.col("pnb")}
    inner = nodes.where("depth > 0")
    children = inner.select(*[c.alias(k) for k, c in up.items()]).groupBy(NODE).agg(F.count("*").alias("n_children"))
    saves = ((F.col("n_convs") - 1) * F.col("words")).alias("saves")
    nodes = nodes.join(children, NODE, "left").select("*", saves).fillna(0, ["n_children"])
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = stash(nodes.withColumn("above", F.coalesce(F.sum("saves").over(above), F.lit(0))))

    own = nodes.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    subtrees = rolled(wide.join(own, "conv_id", "left"), all_saves="coalesce(sum(saves), 0)", n_leaves="coalesce(sum(leaf), 0)").select(*NODE, "all_saves", "n_leaves")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("na").alias("pna"), F.col("nb").alias("pnb"), F.col("conv_id").alias("parent_conv_id"))
    told = stash(nodes.join(parents, ["depth", "pna", "pnb"], "left"))
    told = told.join(subtrees, NODE).join(ends(wide), NODE, "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_saves") - F.col("above")).alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
