"""Merkle manifest of a dataset: a hash for every row, every group and the whole table, with a proof for each row.

A row's leaf is the hash of its fields. Within a group, leaves ascend by key; runs of 8 successive nodes become their parent, level by
level, until one node, the group's root, is left. The roots of all groups, in order of the groups, give the root of the table the same way.

Levels are strings. Rows get their place in the group from a range partitioning and prefix sums; an aligned block of 8**3 places keeps each of its
levels as one string of 64 hex digits a node. Fixed-width substrings of 512 digits are hashed to the next level, and what stands left and right of
a node in its run is its part of the proof. The roots of the blocks are the nodes of the next round, until every group is one block; proofs
pass down block by block. Rounds grow with the logarithm of the table, no row or task holds more than a block.

The strings are kept as bytes, in which a substring is found without counting characters.

Defined results: a null field is hashed as `-`, every other one with its length, so empty and null differ. A null group is a group of its own and
the first; null keys come first in their group. Rows of one key stand in order of their leaves; repeated rows have equal leaves and proofs of
their own. A text of any length is hashed in its row. An empty table gives an empty result and has no root. Fields are read by name and other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.common import materialise

#: Nodes a run and levels a block.
FAN_OUT, LEVELS, DIGITS = 8, 3, 64
BLOCK = FAN_OUT**LEVELS
NO_PROOF = "CAST(array() AS ARRAY<STRUCT<left: BINARY, right: BINARY>>)"


def leaf(fields: list[Column]) -> Column:
    """sha256 of the fields in order, each as its UTF-8 byte count, `:` and value, or `-` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `pos` (from 0, inside g, in the given order) and `total` of g. Equal rows are told apart by their row number, so no key fills a partition."""
    by = ["g", *order, "__row"]
    d = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    d = materialise(d.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("__row", 33).alias("__part")  # rows of a partition have successive numbers above a multiple of 2**33
    stretches = d.groupBy("g", part).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    group = Window.partitionBy("g")
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    stretches = stretches.select("g", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("total"))
    out = d.withColumn("__part", part).join(stretches, ["g", "__part"])
    return out.withColumn("pos", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def parents(level: Column) -> Column:
    """The next level: the hashes of a level's runs, in one string."""
    runs = F.ceil(F.length(level) / (FAN_OUT * DIGITS)).cast("int")
    each = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * FAN_OUT * DIGITS + 1, F.lit(FAN_OUT * DIGITS)), 256))
    return F.array_join(each, "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, total, node, item) -> g, block, total, items, l0 ... (its levels; null above its root), root."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "node", "item")))
    b = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block"), "total").agg(rows.alias("rows"))
    b = b.select("g", "block", "total", F.transform("rows", lambda r: r["item"]).alias("items"), F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary").alias("l0"))
    for j in range(LEVELS):
        more = (F.col("total") > BLOCK) | (F.length(f"l{j}") > DIGITS)  # of several blocks each climbs to the top
        b = b.withColumn(f"l{j + 1}", F.when(more, parents(F.col(f"l{j}"))))
    return b.withColumn("root", F.coalesce(*[F.col(f"l{j}") for j in range(LEVELS, -1, -1)]).cast("string"))


def siblings(i: Column) -> Column:
    """Left and right of place i of a block: one pair a level, from the levels of its row."""
    pairs = []
    for j in range(LEVELS):
        at = F.floor(i / FAN_OUT**j).cast("int")
        first, off = F.floor(at / FAN_OUT).cast("int") * FAN_OUT * DIGITS, (at % FAN_OUT) * DIGITS
        run = F.substring(F.col(f"l{j}"), first + 1, F.lit(FAN_OUT * DIGITS))
        pairs.append(F.when(F.col(f"l{j + 1}").isNotNull(), F.struct(F.substring(run, F.lit(1), off).alias("left"), F.substring(run, off + DIGITS + 1, F.lit(FAN_OUT * DIGITS)).alias("right"))))
    return F.filter(F.array(*pairs), lambda p: p.isNotNull())


def climb(nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Proofs of all nodes -> g, pos, item, node, proof (from the node up), found.

    `above` takes the roots (g, root) of the groups and returns (g, proof, found): their own proofs and what to hand down."""
    b = materialise(blocks(nodes), "blocks")
    if b.filter("block > 0").isEmpty():
        upper = above(b.select("g", "root")).withColumn("block", F.lit(0).cast("long"))
    else:
        tops = b.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("node"), F.lit(None).cast("boolean").alias("item"))
        upper = climb(tops, above).select("g", F.col("pos").alias("block"), "proof", "found")
    each = F.transform("items", lambda item, i: F.struct(
        (F.col("block") * BLOCK + i).alias("pos"), item.alias("item"), F.substring(F.col("l0"), i * DIGITS + 1, F.lit(DIGITS)).cast("string").alias("node"), F.concat(siblings(i), F.col("proof")).alias("proof")))
    return b.join(upper, ["g", "block"]).select("g", "found", F.explode(each).alias("e")).select("g", "e.*", "found")


def manifest(df: DataFrame, key: str, group: str, fields: list[str], **others: Column) -> DataFrame:
    """One row per row of df: key, leaf, subroot (of its group), root, proof (array of left and right siblings, from the leaf up), and the
    columns `others`, evaluated on df.

    The root is the same for any partitioning of the same rows."""
    extra = [c.alias(name) for name, c in others.items()]
    rows = df.select(F.struct(F.col(group).alias("v")).alias("g"), F.struct(F.col(key).alias("key"), *extra).alias("item"), F.col(key).alias("k"), leaf([F.col(f) for f in fields]).alias("node"))
    ordered = placed(materialise(rows, "leaves"), ["k", "node"]).drop("k")  # stored: texts are hashed once, not again for the range bounds

    def table_root(roots: DataFrame) -> DataFrame:
        subroots = placed(roots.select(F.struct(F.lit(0).alias("v")).alias("g"), F.col("g").alias("item"), F.col("root").alias("node")), ["item"])
        top = climb(subroots, lambda r: r.select("g", F.expr(NO_PROOF).alias("proof"), F.struct("root").alias("found")))
        return top.select(F.col("item").alias("g"), "proof", F.struct(F.col("node").alias("subroot"), F.col("found.root").alias("root")).alias("found"))

    out = climb(ordered, table_root)
    return out.select(F.col("item.key").alias(key), F.col("node").alias("leaf"), "found.subroot", "found.root", "proof", *[F.col(f"item.`{n}`").alias(n) for n in others])


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, node, lambda h, s: F.sha2(F.concat(s["left"], h.cast("binary"), s["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings from the leaf up, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"]).cast("string")), "")
