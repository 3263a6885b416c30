"""Merkle manifest of a table: one hash tree per group, one over the groups' roots, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each written with its length.  Leaves of a group are numbered in order; the pivot of a level
spreads the up to `fanout` children of a parent into slot columns by conditional aggregates.  All slot columns together, in order,
hash to the parent; the slot columns but a child's own are its siblings.  Levels go up until a group has one node left, its
subroot; the subroots, in order of their group, are the leaves of the upper tree.  Paths then go down again: a parent hands
its own path and its slots to its children, so that of the big tables only the lowest pivot (a sixteenth of the rows) meets another one.

The texts are read once and never shuffled: only digests, keys and ids move.  A group with most of the rows is spread by ranges of
its order, and is numbered by counts per (group, range).  Every level is written to the checkpoint folder, a sixteenth of the one below.

Defined results: null fields are `-`.  A null group is a group of its own, before all others; rows with null order come first in their group;
rows of equal order ascend by their digest, and equal rows are leaves of their own.  A lone leaf is its group's subroot, and a lone
subroot is the root; both have no siblings, and their proof is the hash of nothing.  An empty table has no nodes and gives
no rows.  Columns that are not fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, measured, numbered, place, shuffle_partitions

FANOUT = 16
#: What is broadcast at most, in bytes: the first positions of the ranges.
MOST_BYTES = 16 << 20


def joined(*parts: Column) -> Column:
    """Digest of hexadecimal digests or other strings, one after the other; nulls are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def written(value: Column) -> Column:
    """A field with its length in bytes before it; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[written(f) for f in fields]).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (checkpointed) with `pos`, from 0 in each `grp` by `order`, and `n`, the rows of the group.

    Rows go to ranges of (grp, order); a range holds few groups, or one group is in many ranges, so the positions at which
    ranges begin come from counts of (grp, range).
    """
    ranges = shuffle_partitions(rows.sparkSession)
    spread = rows.repartitionByRange(ranges, "grp", *order).sortWithinPartitions("grp", *order)
    placed = checkpoint(spread.withColumns({"part": F.spark_partition_id(), "spot": F.monotonically_increasing_id()}))
    runs = placed.groupBy("grp", "part").agg(F.min("spot").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, seen = measured(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("k").over(whole).alias("n")), size=F.sum(F.octet_length("grp") + 48))
    starts = F.broadcast(starts) if seen["size"] <= MOST_BYTES else starts
    return placed.join(starts, ["grp", "part"]).withColumn("pos", F.col("spot") + F.col("shift")).drop("part", "spot", "shift")


@dataclass
class Tree:
    """leaves: grp, pos, n, h and more; levels: per level above grp, pos, n, h and slots `s0`, `s1`, ...; roots: grp, h."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def build(leaves: DataFrame, carried: Sequence[str] = (), fanout: int = FANOUT) -> Tree:
    """The trees of all groups over `leaves` (grp, pos, n, h, and the columns that slots of the lowest level carry)."""
    levels: list[DataFrame] = []
    roots = leaves.filter("n = 1").select("grp", "h")
    below, slot_of = leaves, ["h", *carried]
    while True:
        slot = F.pmod(F.col("pos"), F.lit(fanout))
        wide = below.filter("n > 1").groupBy("grp", F.floor(F.col("pos") / fanout).alias("pos")).agg(
            F.ceil(F.max("n") / fanout).alias("n"), *[F.max(F.when(slot == i, F.struct(*slot_of))).alias(f"s{i}") for i in range(fanout)]
        )
        level, seen = measured(wide.withColumn("h", joined(*[F.col(f"s{i}.h") for i in range(fanout)])), nodes=F.count(F.lit(1)), unfinished=F.max("n"))
        if not seen["nodes"]:
            return Tree(leaves, levels, roots, fanout)
        levels.append(level)
        roots = roots.unionByName(level.filter("n = 1").select("grp", "h"))
        if seen["unfinished"] == 1:
            return Tree(leaves, levels, roots, fanout)
        below, slot_of = level, ["h"]


def _slots(tree: Tree) -> Column:
    return F.array(*[F.col(f"s{i}.h") for i in range(tree.fanout)])


def _step(slots: Column, slot: Column, fanout: int) -> Column:
    """What stands left and right of a slot, as one string each."""
    return F.struct(F.array_join(F.slice(slots, F.lit(1), slot), "").alias("left"), F.array_join(F.slice(slots, slot + 2, F.lit(fanout)), "").alias("right"))


def paths(tree: Tree, top: DataFrame) -> DataFrame:
    """Every leaf: the columns of its slot, those of `top`, and `path`: the steps (left, right) from the leaf up to the root.

    `top` has for each grp the `path` from its subroot on, and any further columns to be handed down.
    """
    handed = [c for c in top.columns if c not in ("grp", "path")]
    lone = tree.leaves.filter("n = 1").drop("pos", "n").join(top, "grp")
    above = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        known = level.filter("n = 1").join(top, "grp")
        if above is not None:
            slot = F.pmod(F.col("pos"), F.lit(tree.fanout)).cast("int")
            step = F.array(_step(F.col("up_slots"), slot, tree.fanout))
            up = above.select("grp", F.col("pos").alias("up"), _slots(tree).alias("up_slots"), F.col("path").alias("up_path"), *handed)
            inner = level.filter("n > 1").withColumn("up", F.floor(F.col("pos") / tree.fanout)).join(up, ["grp", "up"])
            known = known.unionByName(inner.withColumn("path", F.concat(step, F.col("up_path"))).select(*known.columns))
        above = checkpoint(known) if k else known
    if above is None:
        return lone
    kids = above.select("grp", *handed, "path", _slots(tree).alias("slots"), F.posexplode(F.array(*[F.col(f"s{i}") for i in range(tree.fanout)])).alias("slot", "leaf")).filter("leaf is not null")
    down = kids.withColumn("path", F.concat(F.array(_step(F.col("slots"), F.col("slot"), tree.fanout)), F.col("path"))).select("grp", "leaf.*", *handed, "path")
    return lone.select(*down.columns).unionByName(down)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level upwards, left to right."""
    return joined(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


@dataclass
class Manifest:
    trees: Tree
    upper: Tree
    proofs: DataFrame  # id, grp, leaf, tampered, subroot, root, path

    def nodes(self) -> DataFrame:
        """The manifest itself: tree (`group` or `upper`), grp, level, pos and digest of every node."""
        out = None
        for name, tree in (("group", self.trees), ("upper", self.upper)):
            for k, level in enumerate([tree.leaves, *tree.levels]):
                part = level.select(F.lit(name).alias("tree"), "grp", F.lit(k).alias("level"), "pos", F.col("h").alias("digest"))
                out = part if out is None else out.unionByName(part)
        return out


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None, changed: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of docs.  `tampered` names fields with the values (over the fields' names) that rows with `changed` are said to
    have now; such rows get the digest of these values as `tampered`, all others their own leaf."""
    cols = numbered(docs).select(*[place(docs, f).alias(f) for f in dict.fromkeys([*fields, group, order])])
    own = leaf([F.col(f) for f in fields])
    now = F.when(changed, leaf([(tampered or {}).get(f, F.col(f)) for f in fields])) if changed is not None else F.lit(None).cast("string")
    rows = cols.select(group_key(F.col(group)).alias("grp"), F.col(order).alias("id"), own.alias("h"), now.alias("now"), F.monotonically_increasing_id().alias("tie"))
    leaves = positions(checkpoint(rows), ["id", "h", "tie"]).drop("tie")
    trees = build(leaves, ["id", "now"], fanout)
    subroots = positions(checkpoint(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "h")), ["member"])
    upper = build(subroots, ["member"], fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    one = upper.roots.select("grp", none.alias("path"), F.col("h").alias("root"))
    top = checkpoint(paths(upper, one).select(F.col("member").alias("grp"), F.col("h").alias("subroot"), "root", "path"))
    found = paths(trees, top)
    return Manifest(trees, upper, found.select("id", "grp", F.col("h").alias("leaf"), F.coalesce("now", "h").alias("tampered"), "subroot", "root", "path"))


def check(proofs: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root (from the tampered digest and the siblings as they were), verified."""
    folded = proofs.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return folded.select("id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
