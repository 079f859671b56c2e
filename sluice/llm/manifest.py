"""A Merkle tree over a table's rows, with a proof for each row, by time-forward processing.

Nodes carry labels (level, index). A sweep in label order hashes each node from the digests that its children
have sent it through a priority queue and sends its own digest to its parent; a second sweep in reversed order
sends every child what its proof needs from there up. Blocks of ``ARITY ** levels`` neighbours are swept
inside one task with a heap; between blocks Spark's shuffle by (tree, block) is the queue. A round lifts every
tree by ``levels`` levels, so a hot source is many small blocks and there are few rounds at any size.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import staged

ARITY, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "_tree string, _index long, _size long, _digest string"
PATH = "_tree string, _block long, _path array<string>, _subroot string, _root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(size: int) -> int:
    """Levels above a tree's leaves until one node remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def swept_up(first: int, digests: Sequence[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest ``levels`` above neighbouring nodes, and what every node on the way received from its children."""
    queue = [(0, first + i, d) for i, d in enumerate(digests)]
    received: dict[tuple[int, int], list[str]] = {}
    while queue[0][0] < levels:
        level, index, _ = queue[0]
        parent = (level + 1, index // ARITY)
        children = []
        while queue and (queue[0][0] + 1, queue[0][1] // ARITY) == parent:
            children.append(heapq.heappop(queue)[2])
        received[parent] = children
        heapq.heappush(queue, (*parent, digest("".join(children))))
    return queue[0][2], received


def swept_down(received: Mapping[tuple[int, int], list[str]], top: tuple[int, int], above: Sequence[str]) -> dict[int, list[str]]:
    """Per leaf of a block its proof: for each level upwards the siblings before and after, as two texts; ``above`` is the top's."""
    queue = [(-top[0], -top[1], list(above))]
    proofs: dict[int, list[str]] = {}
    while queue:
        level, index, path = heapq.heappop(queue)
        if level == 0:
            proofs[-index] = path
            continue
        children = received[-level, -index]
        for i in range(len(children)):
            own = ["".join(children[:i]), "".join(children[i + 1:])]
            heapq.heappush(queue, (level + 1, index * ARITY - i, own + path))
    return proofs


def folded(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf leads to by its proof."""
    for before, after in zip(path[::2], path[1::2]):
        leaf = digest(before + leaf + after)
    return leaf


def _block(nodes: pa.Table, levels: int) -> tuple[pa.Table, int, int, str, dict[tuple[int, int], list[str]]]:
    """A block in order: its rows, its number, its height, its top digest and what its nodes received."""
    nodes = nodes.sort_by("_index")
    first, size = nodes["_index"][0].as_py(), nodes["_size"][0].as_py()
    height = min(levels, depth(size))
    top, received = swept_up(first, nodes["_digest"].to_pylist(), height)
    return nodes, first // ARITY**levels, height, top, received


def _raised(nodes: pa.Table, levels: int) -> pa.Table:
    rows, number, _, top, _ = _block(nodes, levels)
    size = -(-rows["_size"][0].as_py() // ARITY**levels)
    return pa.table({"_tree": rows["_tree"][:1], "_index": [number], "_size": [size], "_digest": [top]})


def _paths(nodes: pa.Table, above: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    rows, number, height, _, received = _block(nodes, levels)
    proofs = swept_down(received, (height, number * ARITY ** (levels - height)), above["_path"][0].as_py())
    return rows, [proofs[i] for i in rows["_index"].to_pylist()]


def _delivered(nodes: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """Per node of a block, which is the top of a block below, the proof from there up."""
    rows, paths = _paths(nodes, above, levels)
    same = {c: pa.array([above[c][0].as_py()] * len(rows), pa.string()) for c in ("_subroot", "_root")}
    return pa.table({"_tree": rows["_tree"], "_block": rows["_index"], "_path": pa.array(paths, pa.list_(pa.string())), **same})


def _proved(nodes: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """Per leaf its result, without the proof itself."""
    rows, paths = _paths(nodes, above, levels)
    subroot, root = above["_subroot"][0].as_py(), above["_root"][0].as_py()
    roots = [folded(leaf, path) for leaf, path in zip(rows["_found"].to_pylist(), paths)]
    return pa.table({
        "_id": rows["_id"], "leaf": rows["_digest"], "subroot": pa.array([subroot] * len(rows), pa.string()),
        "root": pa.array([root] * len(rows), pa.string()), "proof_sha256": [digest("".join(path)) for path in paths],
        "folded_root": roots, "verified": [r == root for r in roots]})


def field(name: str, value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; null as a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)).alias(name)


def leaf(values: Mapping[str, Column], fields: Sequence[str]) -> Column:
    return F.sha2(F.concat(*[field(f, values[f]) for f in fields]), 256)


def ranked(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Number the rows of each ``_tree`` from 0 in the given order (``_index``) and count them (``_size``).

    Rows are sorted by range, so that no task gets a whole tree; only one count for each tree and partition is summed up.
    """
    sorted_ = rows.repartitionByRange("_tree", *order).sortWithinPartitions("_tree", *order)
    kept = staged(sorted_.withColumn("_at", F.monotonically_increasing_id()), label)
    kept = kept.withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = kept.groupBy("_tree", "_part").agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    tree = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("_size"))
    placed = kept.join(places, ["_tree", "_part"])
    return placed.withColumn("_index", F.col("_shift") + F.col("_local")).drop("_at", "_part", "_local", "_shift")


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.call_function("div", F.col("_index"), F.lit(ARITY**levels)))


def raised(nodes: DataFrame, label: str, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each round of blocks, from the given ones to one node a tree."""
    rounds = [staged(_with_block(nodes, levels), label)]
    size = rounds[0].agg(F.max("_size")).first()[0] or 0
    while size > 1:
        tops = rounds[-1].select("_block", "_tree", "_index", "_size", "_digest").groupBy("_tree", "_block").applyInArrow(
            lambda rows: _raised(rows, levels), NODE)
        rounds.append(staged(_with_block(tops, levels), label))
        size = -(-size // ARITY**levels)
    return rounds


def delivered(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The proofs of the tops of the first round's blocks, from the proofs of the trees' roots down."""
    for nodes in reversed(rounds[1:-1]):
        own = nodes.select("_tree", "_block", "_index", "_size", "_digest").groupBy("_tree", "_block")
        above = staged(own.cogroup(above.groupBy("_tree", "_block")).applyInArrow(
            lambda rows, top: _delivered(rows, top, levels), PATH), "merkle-proofs")
    return above


def manifest(docs: DataFrame, found: Mapping[str, Column] | None = None, fields: Sequence[str] = FIELDS,
             tree: str = "source", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """One row per row: its leaf, its tree's root, the root over all trees, its proof's digest and what the proof says.

    A leaf is the SHA-256 of the row's fields, each with its length. Each value of ``tree`` has a tree over its
    rows in the order of ``order``; null is a tree of its own and comes first. The roots of the trees, in bytewise
    order of that value, are the leaves of the tree that gives ``root``. ``found`` maps fields to what is found
    there now; the proof is folded from the leaf of these, so ``verified`` is false exactly where they differ.

    Rows with the same order value stand by their leaf, so repeated rows change nothing; null stands first. Null
    fields differ from empty ones. A text of any length is one field. An empty table gives no rows. Other columns
    are not read.
    """
    now = {f: F.col(f"`{f}`") for f in fields}
    seen = now | dict(found or {})
    id_type = docs.schema[order].dataType
    # null before every text, and no null to join on
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{tree}`").cast("string")), F.lit("n"))
    leaves = staged(docs.select(
        key.alias("_tree"), F.col(f"`{order}`").alias("_id"), leaf(now, fields).alias("_digest"), leaf(seen, fields).alias("_found"),
        F.monotonically_increasing_id().alias("_mid")), "merkle-leaves")
    lower = raised(ranked(leaves, ["_id", "_digest", "_mid"], "merkle-order").drop("_mid"), "merkle-rounds", levels)
    subroots = lower[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_of"), "_digest")
    upper = raised(ranked(subroots, ["_of"], "merkle-subroots"), "merkle-tops", levels)
    nothing = F.array().cast("array<string>")
    top = upper[-1].select("_tree", "_block", nothing.alias("_path"), F.lit(None).cast("string").alias("_subroot"), F.col("_digest").alias("_root"))
    proofs = upper[0].select("_tree", "_block", "_index", "_size", "_digest", "_of").groupBy("_tree", "_block").cogroup(
        delivered(upper, top, levels).groupBy("_tree", "_block")).applyInArrow(lambda rows, above: _of_trees(rows, above, levels), PATH)
    blocks = delivered(lower, staged(proofs, "merkle-proofs"), levels)
    own = lower[0].select("_tree", "_block", "_index", "_size", "_digest", "_found", "_id").groupBy("_tree", "_block")
    schema = f"_id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return own.cogroup(blocks.groupBy("_tree", "_block")).applyInArrow(
        lambda rows, above: _proved(rows, above, levels), schema).withColumnRenamed("_id", order)


def _of_trees(nodes: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """Per tree the proof of its root, which is the top of its last block."""
    rows, paths = _paths(nodes, above, levels)
    return pa.table({
        "_tree": rows["_of"], "_block": pa.array([0] * len(rows), pa.int64()), "_path": pa.array(paths, pa.list_(pa.string())),
        "_subroot": rows["_digest"], "_root": pa.array([above["_root"][0].as_py()] * len(rows), pa.string())})
