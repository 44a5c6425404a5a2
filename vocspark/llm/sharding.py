"""Operator 3 — sharding by a hierarchical weighted hash tree (DataFrame functions only).

The tree has three levels: region, rack, shard. A key descends it: at each level every child
draws -ln(u) / weight, where u is a hash of (seed, child, key), and the smallest draw wins. So a
child gets keys in proportion to its weight, and when a weight changes, keys move only into or out
of the child whose weight changed: all other draws stay as they are.

`topology` fills racks and regions in order. A shard that opens a new region therefore takes keys
only into itself. A shard added to a rack that already has others raises the weights of its rack
and region; keys then move only into that subtree, where its shards share them.

Cases: a null key draws like the text "null"; repeated rows get the same shard and a slot each; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit_hash

SEED = 17
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 5


@dataclass(frozen=True)
class Node:
    """A child of `parent` at one level, with the sum of the weights below it."""

    level: int
    parent: int
    id: int
    weight: float


def topology(n_shards: int, weights: dict[int, float] | None = None,
             racks_per_region: int = RACKS_PER_REGION, shards_per_rack: int = SHARDS_PER_RACK) -> list[Node]:
    """The tree over shards 0 .. n_shards - 1, filled rack by rack; weights default to 1."""
    if n_shards < 1:
        raise ValueError("a tree needs at least one shard")
    w = {s: float((weights or {}).get(s, 1.0)) for s in range(n_shards)}
    if any(x <= 0 for x in w.values()):
        raise ValueError("weights must be above 0")
    rack_of = {s: s // shards_per_rack for s in w}
    racks = sorted(set(rack_of.values()))
    rack_w = {r: sum(w[s] for s in w if rack_of[s] == r) for r in racks}
    regions = sorted({r // racks_per_region for r in racks})
    region_w = {g: sum(rack_w[r] for r in racks if r // racks_per_region == g) for g in regions}
    return ([Node(0, 0, g, region_w[g]) for g in regions]
            + [Node(1, r // racks_per_region, r, rack_w[r]) for r in racks]
            + [Node(2, rack_of[s], s, w[s]) for s in w])


LEVELS = ("region", "rack", "shard")


def _children(nodes: list[Node], level: int) -> Column:
    """A literal map from each parent to its children: array of (id, weight)."""
    by_parent: dict[int, list[Node]] = {}
    for n in nodes:
        if n.level == level:
            by_parent.setdefault(n.parent, []).append(n)
    entries: list[Column] = []
    for parent, kids in by_parent.items():
        entries += [F.lit(parent), F.array(*[F.struct(F.lit(n.id).alias("id"), F.lit(n.weight).alias("weight"))
                                             for n in kids])]
    return F.create_map(*entries)


def _drawing(name: str, key: Column, seed: int):
    def draw(n: Column) -> Column:
        u = unit_hash(F.lit(seed), F.lit(name), n["id"], key)
        return F.struct((-F.log(u) / n["weight"]).alias("draw"), n["id"].alias("id"))
    return draw


def descend(df: DataFrame, key: str, nodes: list[Node], out: str, seed: int = SEED) -> DataFrame:
    """Adds the shard (int, `out`) of each row's key; only the chosen child's children are drawn for."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    at = F.lit(0)
    path = []
    for level, name in enumerate(LEVELS):
        draws = F.transform(F.element_at(_children(nodes, level), at), _drawing(name, k, seed))
        step = f"__{out}_{name}"
        df = df.withColumn(step, F.array_min(draws)["id"])
        at = F.col(step)
        path.append(step)
    return df.withColumn(out, at.cast("int")).drop(*path)


def gapless_slots(df: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Adds a number from 0 without gaps within each group, without putting a group into one task.

    Rows go to one of 256 blocks of their group by the md5 of the order columns; the table of block
    counts gives each block its offset, and rows are numbered within their block. That table has at
    most 256 rows for each group and is broadcast, so there must be few groups (shards)."""
    df = df.withColumn("__block", F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order])), 1, 2))
    counts = df.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__block").alias("__b"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(group, "__block").orderBy(*order)
    numbered = df.withColumn("__row", F.row_number().over(within) - 1)
    return (numbered.join(F.broadcast(offsets), (F.col(group) == F.col("__g")) & (F.col("__block") == F.col("__b")))
            .withColumn(out, (F.col("__offset") + F.col("__row")).cast("long"))
            .drop("__block", "__b", "__g", "__offset", "__row"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: the law `key`.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 is of the same bytes;
    grown_shard is the shard if the tree had one shard more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = descend(rows, "doc_id", topology(n_shards), "shard", seed)
    rows = descend(rows, "doc_id", topology(n_shards + 1), "grown_shard", seed)
    return gapless_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
