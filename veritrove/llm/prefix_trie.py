"""Conversation prefix trie by heavy paths.

Rebuilt conversations are sequences of turns (role, text); a node is a distinct
sequence of first d turns, the root the one of none. A node's key is its depth
and 128 bits: the running xor of two hashes of (position, turn). Running
aggregates are of two levels, within blocks of BLOCK turns of a conversation
and over the blocks' totals, so that a conversation of any length is spread
over tasks.

Subtree sums go by heavy-path decomposition:

1. Each node's heavy child is the one of most conversations; every other child
   is light and has at most half of its parent's, so no node has more than
   log2(conversations) light nodes above it.
2. A path runs from a light node (or the root) down heavy children to a leaf.
   All its nodes hold the leaf's smallest conversation, so the path is the
   array of that conversation's nodes from its deepest light one on. A path's
   level is the number of light nodes on the conversation's way.
3. Rounds. From the deepest level up, the paths' totals are attached to the
   parents of their first nodes, which lie on paths one level up: as many
   rounds as there are levels, each over its own level's paths alone.
4. Suffix sums along every path's array, attached totals included, give each
   node's subtree.

Defined cases: rows without a conv_id belong to no conversation and are left
out; null roles and texts are empty ones; rows of one conversation and turn
stand in the order of the digests of their contents, repeated rows are turns
each; a conversation without turns after being rebuilt is a member of the root
alone; an empty table has no nodes; other columns, whatever their names, aren't
read. Two different sequences of one depth have one key with a probability of
2^-128.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.digest import joined_digests
from .shared import discard, stored

#: Turns of a conversation, or nodes of a path, that one window holds.
BLOCK = 512
#: Conversations in a family, and the bound of the turns that one takes from its family's first.
FAMILY, SHARED = 20, 4


def family_head(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def running(rows: DataFrame, by: str, at: str, fold: Callable[[Column], Column], add: Callable[[Column, Column], Column], columns: dict[str, str], zero: Column, descending: bool = False) -> DataFrame:
    """Running aggregates of columns (input name -> output name) along `at`, a dense number, in blocks.

    fold is an aggregate, add merges two of its results; rows are the window's
    own columns and the outputs.
    """
    block = F.floor(F.col(at) / BLOCK)
    along = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cut = rows.withColumn("_block", block)
    own = Window.partitionBy(by, "_block").orderBy(along(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_by").orderBy(along("_at")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(*[fold(F.col(c)).alias(f"_{o}") for c, o in columns.items()])
    carried = totals.select("_by", "_at", *[fold(F.col(f"_{o}")).over(before).alias(f"_{o}") for o in columns.values()]).where(" or ".join(f"_{o} is not null" for o in columns.values()))
    inside = cut.select("*", *[fold(F.col(c)).over(own).alias(o) for c, o in columns.items()])
    joined = inside.join(carried, (F.col(by) == F.col("_by")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*rows.columns, *[add(F.col(o), F.coalesce(F.col(f"_{o}"), zero)).alias(o) for o in columns.values()])


def turns_in_order(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv, n, p, m, words): each turn's place from 1 in its conversation of n, digest and words.

    Rows are partitioned by ranges of (conversation, turn), so a conversation
    may lie in several; places are counted within a range and carried over.
    """
    role, text = F.coalesce(F.col(f"`{role_column}`"), F.lit("")), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    turns = conversations.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("bigint").alias("conv"), F.col(f"`{turn_column}`").alias("turn"), digest.alias("m"), words.alias("words"))
    dealt = stored(turns.repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("m")).withColumn("range", F.spark_partition_id()), "turns")
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), "m"))
    whole = Window.partitionBy("_conv")
    sizes = dealt.groupBy(F.col("conv").alias("_conv"), F.col("range").alias("_range")).agg(F.count(F.lit(1)).alias("here"))
    sizes = sizes.select("_conv", "_range", F.coalesce(F.sum("here").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    placed = dealt.withColumn("p", place).join(sizes, (F.col("conv") == F.col("_conv")) & (F.col("range") == F.col("_range")))
    out = stored(placed.select("conv", "n", (F.col("p") + F.col("before")).alias("p"), "m", "words"), "own")
    discard(dealt)
    return out


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: c, length; their turns: c, d, length, m, words)."""
    each = own.where("p = 1").select(F.col("conv").alias("c"), "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), family_head(F.col("conv")).alias("h"))
    first = own.where(F.col("p") < SHARED).select(F.col("conv").alias("_base"), "n", "p", "m", "words")
    sizes = first.where("p = 1").select("_base", F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    known = each.join(sizes, F.col("base") == F.col("_base"), "left").select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    known = stored(known, "known")
    heads = known.join(first, (F.col("base") == F.col("_base")) & (F.col("p") <= F.col("h"))).select("c", F.col("p").alias("d"), "length", "m", "words")
    tails = own.join(known, F.col("conv") == F.col("c")).where("p > h").select("c", (F.col("taken") + F.col("p") - F.col("h")).alias("d"), "length", "m", "words")
    return known, heads.unionByName(tails)


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = turns_in_order(conversations, id_column, turn_column, role_column, text_column)
    known, turns = rebuilt(own)
    marked = turns.withColumns({"x1": F.xxhash64("d", "m"), "x2": F.xxhash64("m", "d")})
    keyed = running(marked, "c", "d", F.bit_xor, lambda a, b: a.bitwiseXOR(b), {"x1": "k1", "x2": "k2"}, F.lit(0).cast("bigint"))
    # A parent's key is the node's without its own turn.
    rows = stored(keyed.select("c", F.col("d").cast("bigint").alias("d"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", (F.col("d") == F.col("length")).alias("ends")), "rows")
    nothing = F.lit(0).cast("bigint")
    root = known.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(nothing.alias("d"), nothing.alias("k1"), nothing.alias("k2"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"), nothing.alias("words"), "conv_id", "n_convs")
    nodes = stored(rows.groupBy("d", "k1", "k2", "p1", "p2", "words").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).unionByName(root), "nodes")
    # Children of each node, and the heavy one among them.
    most = F.max(F.struct("n_convs", "k1", "k2"))
    children = nodes.where("d > 0").groupBy(F.col("p1").alias("_1"), F.col("p2").alias("_2")).agg(F.count(F.lit(1)).alias("n_children"), most.alias("heavy"))
    grown = stored(nodes.join(children, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left").select(*nodes.columns, F.coalesce("n_children", nothing).alias("n_children"), F.col("heavy.k1").alias("h1"), F.col("heavy.k2").alias("h2")), "grown")
    parents = grown.where("n_children > 0").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("conv_id").alias("parent_conv_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    family = grown.join(parents, (F.col("p1") == F.col("_1")) & (F.col("p2") == F.col("_2")), "left").select(
        *nodes.columns, "n_children", "parent_conv_id", ((F.col("d") > 0) & ((F.col("k1") != F.col("_h1")) | (F.col("k2") != F.col("_h2")))).alias("light"))
    family = stored(family, "family")
    # Paths: a leaf's smallest conversation from its deepest light node on.
    leaves = family.where("n_children = 0").select(F.col("conv_id").alias("e"))
    light = family.where("light").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"))
    ways = stored(rows.join(leaves, F.col("c") == F.col("e"), "left_semi").select("c", "d", "k1", "k2"), "ways")
    bends = ways.join(light, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).groupBy(F.col("c").alias("_e")).agg(F.max("d").alias("top"), F.count(F.lit(1)).alias("level"))
    paths = stored(leaves.join(bends, F.col("e") == F.col("_e"), "left").select("e", F.coalesce("top", nothing).alias("top"), F.coalesce("level", nothing).alias("level")), "paths")
    on_path = ways.join(paths, (F.col("c") == F.col("e")) & (F.col("d") >= F.col("top"))).select("e", "top", "level", F.col("k1").alias("_1"), F.col("k2").alias("_2"))
    on_path = on_path.unionByName(paths.where("level = 0").select("e", "top", "level", nothing.alias("_1"), nothing.alias("_2")))
    placed = stored(family.join(on_path, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))).select(
        "e", "top", "level", "d", "k1", "k2", "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf")), "placed")
    attached = _attached(placed)
    at = attached.groupBy(F.col("up").alias("_e"), F.col("up_d").alias("_d")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    sums = placed.join(at, (F.col("e") == F.col("_e")) & (F.col("d") == F.col("_d")), "left").select(
        "e", "d", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("saved") + F.coalesce("more_saved", nothing)).alias("saved"), (F.col("leaf") + F.coalesce("more_leaves", nothing)).alias("leaf"))
    sums = running(sums, "e", "d", F.sum, lambda a, b: a + b, {"saved": "saved_tokens", "leaf": "n_leaves"}, nothing, descending=True)
    # Members that end at a node, in ascending order.
    ends = stored(rows.where("ends").select("k1", "k2", "c").unionByName(known.where("length = 0").select(nothing.alias("k1"), nothing.alias("k2"), "c")), "ends")
    digests = joined_digests(ends, ["k1", "k2"], "c").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "sha256")
    out = sums.join(digests, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    discard(own, nodes, grown, ways, rows, family, paths)
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def _attached(placed: DataFrame) -> DataFrame:
    """(up, up_d, saved, leaf): totals of light paths at their first node's parent, the deepest level first."""
    first = placed.where("d = top and d > 0").select("e", F.col("p1").alias("_1"), F.col("p2").alias("_2"))
    parent = placed.where("n_children > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("e").alias("up"), F.col("d").alias("up_d"))
    hung = first.join(parent, (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2"))).select(F.col("e").alias("_e"), "up", "up_d")
    totals = placed.where("level > 0").groupBy("e", "level").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    light = stored(totals.join(hung, F.col("e") == F.col("_e")).select("e", "level", "up", "up_d", "saved", "leaf"), "light")
    top, done = light.agg(F.max("level")).first()[0] or 0, []
    for level in range(top, 0, -1):
        here = light.where(F.col("level") == level)
        if done:
            below = done[-1].groupBy(F.col("up").alias("_e")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaf"))
            more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
            here = here.join(below, F.col("e") == F.col("_e"), "left").select("up", "up_d", more("saved"), more("leaf"))
        done.append(stored(here.groupBy("up", "up_d").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")), "attached"))
    out = light.where("false").select("up", "up_d", "saved", "leaf")
    for part in done:
        out = out.unionByName(part)
    return out
