"""A Merkle manifest of a dataset: a digest per row, one tree per group, one tree over the groups.

Every row is a leaf. Leaves of a group stand in ascending order of their id; runs of eight nodes
become their parent until one node, the group's subroot, is left. The subroots, in the order of
their groups, become the root in the same way. A row's proof is the list of its siblings' digests
on the way up: with it, and the row alone, anyone can recompute the root.

Positions come from one range sort. Nodes are cut into superblocks of 8^4 neighbours. Each
superblock is reduced to one outer node, the outer nodes form the same kind of tree one storey up,
and then leaves and the outer nodes they need are cogrouped by superblock: the group finishes its
local reduction, puts local and outer siblings together to whole proofs, and folds every leaf up to
the root. No task ever holds more than a superblock and its outer path, however large a group is,
and only digests travel, never texts.

Defined results: a null field is ``-``; leaves without id come first; rows with equal ids stand in
the order of their digests, so repeated rows have equal leaves and neighbouring places; rows without
group form a group of their own before all others; a leaf alone in its group is the subroot; a row
without siblings has the digest of the empty text as its proof; an empty table gives an empty table. Columns
other than the hashed fields take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwise.session import cut_lineage

RUN = 8
# Storeys that a superblock spans, and the nodes it holds at most.
STOREYS = 4
SUPERBLOCK = RUN**STOREYS


# --- digests -----------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A value with the length of its UTF-8 form before it, so that fields can't run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(value) for value in values]).cast("binary"), 256))


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode("ascii")).hexdigest()


# --- trees, inside one superblock --------------------------------------------------------------


def storeys_of(count: int) -> int:
    """How often a group of ``count`` nodes is reduced until one is left."""
    storeys = 0
    while count > 1:
        count, storeys = -(-count // RUN), storeys + 1
    return storeys


def reduction(nodes: list[str], storeys: int) -> list[list[str]]:
    """The nodes of each storey, from the given ones to the last."""
    levels = [nodes]
    for _ in range(storeys):
        below = levels[-1]
        levels.append([parent(below[i : i + RUN]) for i in range(0, len(below), RUN)])
    return levels


def local_path(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """On each storey the siblings to the left and to the right of the way up from ``place``."""
    path = []
    for level in levels[:-1]:
        start = place - place % RUN
        path.append(("".join(level[start:place]), "".join(level[place + 1 : start + RUN])))
        place //= RUN
    return path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode("ascii")).hexdigest()
    return digest


# --- Spark -------------------------------------------------------------------------------------


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``position``, a row's place in its group from 0, and ``members``, the group's rows.

    One range sort: a group of any size is spread over as many partitions as it needs. Within a
    partition places follow from the row numbers, and a table of one row per partition and group
    says where each partition starts.
    """
    dealt = cut_lineage(
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    parts = dealt.groupBy(group, "part").agg(
        F.min("in_part").alias("first"), F.count("*").alias("held")
    )
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        group,
        "part",
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy(group)).alias("members"),
    )
    return (
        dealt.join(starts, [group, "part"])
        .withColumn("position", F.col("in_part") + F.col("shift"))
        .drop("part", "in_part", "shift")
    )


PATH = "array<struct<left:string,right:string>>"


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """Superblocks reduced to their top: (group, position, members, node) one storey of blocks up."""

    def reduce(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("position")
        members = int(found["members"].iloc[0])
        digests = [value.hex() for value in found["node"]]
        top = reduction(digests, min(STOREYS, storeys_of(members)))[-1]
        return pd.DataFrame(
            {
                group: [key[0]],
                "position": [key[1]],
                "members": [-(-members // SUPERBLOCK)],
                "node": [bytes.fromhex(top[0])],
            }
        )

    kind = nodes.schema[group].dataType.simpleString()
    return (
        nodes.select(
            group,
            (F.col("position") / SUPERBLOCK).cast("long").alias("block"),
            "position",
            "members",
            "node",
        )
        .groupBy(group, "block")
        .applyInPandas(reduce, f"{group} {kind}, position long, members long, node binary")
    )


def _superblocks(
    nodes: DataFrame, outer: DataFrame, group: str, finish: Callable, schema: str
) -> DataFrame:
    """Cogroup nodes with the outer node of their superblock and finish both together.

    ``finish`` gets the group's rows in order, the storeys of the local reduction, the outer path
    and the outer table's row.
    """

    def join(found: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("position").reset_index(drop=True)
        members = int(found["members"].iloc[0])
        digests = [value.hex() for value in found["node"]]
        levels = reduction(digests, min(STOREYS, storeys_of(members)))
        up = [(step["left"], step["right"]) for step in above["path"].iloc[0]]
        return finish(found, levels, up, above.iloc[0])

    block = (F.col("position") / SUPERBLOCK).cast("long")
    left = nodes.withColumn("block", block).groupBy(group, "block")
    return left.cogroup(outer.groupBy(group, "position")).applyInPandas(join, schema)


def outer_paths(nodes: DataFrame, group: str, largest: int) -> DataFrame:
    """(group, position, path, top) for every node of a storey of superblocks.

    ``path`` leads to the top of the group's tree, ``top`` is that node. ``largest`` is the number
    of nodes in the largest group: a storey of superblocks is added while it exceeds one node.
    """
    kind = nodes.schema[group].dataType.simpleString()
    if largest <= 1:
        return nodes.select(
            group,
            "position",
            F.array().cast(PATH).alias("path"),
            F.col("node").alias("top"),
        )
    blocks = cut_lineage(_blocks(nodes, group))
    above = outer_paths(blocks, group, -(-largest // SUPERBLOCK))

    def finish(found, levels, up, outer) -> pd.DataFrame:
        paths = [
            [{"left": a, "right": b} for a, b in local_path(levels, place) + up]
            for place in range(len(found))
        ]
        return pd.DataFrame(
            {
                group: found[group],
                "position": found["position"],
                "path": paths,
                "top": outer["top"],
            }
        )

    schema = f"{group} {kind}, position long, path {PATH}, top binary"
    return cut_lineage(_superblocks(nodes, above, group, finish, schema))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("members")).first()[0] or 0


def manifest(leaves: DataFrame) -> DataFrame:
    """The whole manifest of ``leaves``: every leaf with its roots, proof and folded root.

    ``leaves`` holds ``grp`` (string, not null, in the order of the groups), ``id``, ``node`` (the
    digest, binary) and ``tampered`` (another digest to fold up with the siblings of the original,
    or null). Returns ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` and ``folded_root``,
    digests as hex text. Texts are read once: the leaves are written before they are sorted.
    """
    kind = leaves.schema["id"].dataType.simpleString()
    nodes = numbered(cut_lineage(leaves), "grp", "id", "node")
    # As text, ids pass through pandas unchanged, null or not.
    nodes = cut_lineage(nodes.withColumn("id", F.col("id").cast("string")))
    largest = _largest(nodes)
    blocks = cut_lineage(_blocks(nodes, "grp"))
    in_group = outer_paths(blocks, "grp", -(-largest // SUPERBLOCK))

    # The tree over the groups: one row per group, in a single group of their own.
    tops = in_group.filter("position = 0").select(
        F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("top").alias("node")
    )
    tops = cut_lineage(numbered(tops, "grp", "id"))
    groups = _largest(tops)
    above = outer_paths(
        cut_lineage(_blocks(tops, "grp")), "grp", -(-groups // SUPERBLOCK)
    )

    def finish_group(found, levels, up, outer) -> pd.DataFrame:
        paths = [
            [{"left": a, "right": b} for a, b in local_path(levels, place) + up]
            for place in range(len(found))
        ]
        return pd.DataFrame({"grp": found["id"], "group_path": paths, "root": outer["top"]})

    roots = _superblocks(
        tops, above, "grp", finish_group, f"grp string, group_path {PATH}, root binary"
    )
    outer = in_group.join(cut_lineage(roots), "grp").select(
        "grp",
        "position",
        F.concat("path", "group_path").alias("path"),
        F.lower(F.hex("top")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
    )

    def finish(found, levels, up, above) -> pd.DataFrame:
        above_text = "".join(left + right for left, right in up).encode("ascii")
        leaves, proofs, folded = levels[0], [], []
        for place, tampered in enumerate(found["tampered"]):
            path = local_path(levels, place)
            proof = hashlib.sha256("".join(a + b for a, b in path).encode("ascii"))
            proof.update(above_text)
            proofs.append(proof.hexdigest())
            start = leaves[place] if tampered is None else bytes(tampered).hex()
            folded.append(fold(fold(start, path), up))
        return pd.DataFrame(
            {
                "id": found["id"],
                "leaf": leaves,
                "subroot": above["subroot"],
                "root": above["root"],
                "proof_sha256": proofs,
                "folded_root": folded,
            }
        )

    schema = (
        "id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string"
    )
    proven = _superblocks(nodes, outer, "grp", finish, schema)
    return proven.withColumn("id", F.col("id").cast(kind))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def with_proofs(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    doc_id: str = "doc_id",
    group: str = "lang",
    text: str = "text",
    tampered: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its id and what the manifest says of it, with ``verified``.

    ``fields`` are hashed in their order. Where the condition ``tampered`` (SQL) holds the row
    is checked as if its text had been lower-cased after the manifest was made.
    """

    def digest(body: Column) -> Column:
        return leaf_digest(*[body if name == text else F.col(f"`{name}`") for name in fields])

    changed = F.coalesce(F.expr(tampered or "false"), F.lit(False))
    body = F.col(f"`{text}`")
    leaves = docs.select(
        F.when(F.col(f"`{group}`").isNull(), "")
        .otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
        .alias("grp"),
        F.col(f"`{doc_id}`").alias("id"),
        digest(body).alias("node"),
        F.when(changed, digest(lowered(body))).alias("tampered"),
    )
    return (
        manifest(leaves)
        .withColumnRenamed("id", doc_id)
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
