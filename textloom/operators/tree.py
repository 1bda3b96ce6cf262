"""Content of tree elements: leaves gathered along a parent relation of any depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.packed import together
from textloom.sources.scratch import stored

#: Nodes of a document that one task links: those whose numbers are equal when divided by it.
BLOCK = 65_536


def _up_in_block(size: int):
    """For each node of a block its holder, or the parent with which its chain goes on in another block."""

    def run(t: pa.Table) -> pa.Table:
        node, holds = t["node"].to_numpy(), t["holds"].to_numpy()
        known = t["parent"].is_valid().to_numpy()
        parent = t["parent"].fill_null(0).to_numpy()
        order = np.argsort(node, kind="stable")
        at = np.minimum(np.searchsorted(node, parent, sorter=order), len(node) - 1)
        inside = known & ~holds & (node[order[at]] == parent)
        up = np.where(inside, order[at], np.arange(len(node)))
        for _ in range(len(node).bit_length()):  # what has not come to an end then is a cycle
            up = up[up]
        ends = ~inside[up]
        held, leaves = ends & holds[up], ends & ~holds[up] & known[up] & (parent[up] // size != node // size)
        holder = pa.array(node[up], t["node"].type, mask=~held)
        return pa.table({"doc": t["doc"], "node": t["node"], "holder": holder, "up": pa.array(parent[up], t["parent"].type, mask=~leaves)})

    return run


def holders(nodes: DataFrame, holds: Column) -> DataFrame:
    """(doc, node, holder): the nearest element on the way up, the node itself included, for which ``holds`` is true; null if there is none.

    ``nodes(doc, node, parent, ...)`` may be chains of any depth. Blocks of a document are linked by arrays; only the nodes with which chains
    enter another block are joined: their pointers are doubled, each round a table of the shared folder, so a chain over n blocks takes log2(n)
    rounds. A parent that is no node ends a chain; nodes on a cycle without a holder have none.
    """
    own = nodes.where("node is not null").select("doc", "node", "parent", F.coalesce(holds, F.lit(False)).alias("holds"), F.floor(F.col("node") / BLOCK).alias("block"))
    doc, node, parent = (own.schema[c].dataType.simpleString() for c in ("doc", "node", "parent"))
    now = stored(own.groupBy("doc", "block").applyInArrow(_up_in_block(BLOCK), f"doc {doc}, node {node}, holder {node}, up {parent}"), "holders")
    going = now.where("up is not null")
    if going.isEmpty():
        return now.select("doc", "node", "holder")
    gates = stored(going.select("doc", F.col("up").alias("node")).distinct().join(now, ["doc", "node"]), "gates")
    for _ in range(64):  # 2^64 blocks; what is open then is a cycle
        if gates.where("holder is null and up is not null").isEmpty():
            break
        above = gates.select("doc", F.col("node").alias("up"), F.col("holder").alias("h__"), F.col("up").alias("u__"))
        found = F.coalesce("holder", "h__")
        gates = stored(gates.join(above, ["doc", "up"], "left").select("doc", "node", found.alias("holder"), F.when(found.isNull(), F.col("u__")).alias("up")), "gates")
    through = going.select("doc", "node", "up").join(gates.select("doc", F.col("node").alias("up"), "holder"), ["doc", "up"], "left")
    return now.where("up is null").select("doc", "node", "holder").unionByName(through.select("doc", "node", "holder"))


def _places(doc: np.ndarray, node: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of nodes, and for each wanted one of document ``of`` where those equal to it begin and end in that order."""
    node, wanted = node.astype(np.int64), wanted.astype(np.int64)
    low = min(node.min(), wanted.min())
    span = int(max(node.max(), wanted.max())) - int(low) + 1
    if span * (int(max(doc.max(), of.max())) + 1) >= 2**63:  # numbers with wide gaps count by their rank
        both = np.unique(np.concatenate([node, wanted]), return_inverse=True)[1]
        node, wanted, low, span = both[: len(node)], both[len(node) :], 0, int(both.max()) + 1
    key, sought = doc * span + (node - low), of * span + (wanted - low)
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key, sought, sorter=order), np.searchsorted(key, sought, side="right", sorter=order)


def _up(t: dict) -> np.ndarray:
    """The place of each node's holder among the nodes of all documents, -1 if there is none."""
    node, holds, known = t["node"].to_numpy(zero_copy_only=False), t["holds"].to_numpy(zero_copy_only=False), t["parent"].is_valid().to_numpy(zero_copy_only=False)
    order, first, last = _places(t["of__"], node, t["of__"], t["parent"].fill_null(0).to_numpy(zero_copy_only=False).astype(node.dtype))
    up = np.where(known & ~holds & (first < last), order[np.minimum(first, len(node) - 1)], np.arange(len(node)))
    ends = up == np.arange(len(node))
    for _ in range(len(node).bit_length()):  # what has not come to an end then is a cycle
        further = up[up]
        if np.array_equal(further, up):
            break
        up = further
    return np.where(ends[up] & holds[up], up, -1)


def _gathered(keys: pa.Array, found: list[dict]) -> pa.Table:
    nodes, leaves = found
    none = np.zeros(0, np.int64)
    if len(nodes["of__"]) and len(leaves["of__"]):
        order, first, last = _places(nodes["of__"], nodes["node"].to_numpy(zero_copy_only=False), leaves["of__"], leaves["node"].to_numpy(zero_copy_only=False))
        n = last - first
        leaf = np.repeat(np.arange(len(n)), n)
        holder = _up(nodes)[order[np.repeat(first, n) + np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)]]
        leaf, holder = leaf[holder >= 0], holder[holder >= 0]
    else:
        leaf = holder = none
    doc, node = nodes["of__"][holder], nodes["node"].take(pa.array(holder))
    by = [doc, node.to_numpy(zero_copy_only=False)]
    for c in ("page", "mcid"):  # nulls first
        x = leaves[c].take(pa.array(leaf))
        by += [x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy(zero_copy_only=False)]
    texts = leaves["text"].take(pa.array(leaf))
    order = np.lexsort(by[::-1])
    if len(order):
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in by])
        ties = order[np.append(same, False) | np.append(False, same)]  # of equal places the lesser text comes first
        rank = np.zeros(len(order), np.int64)
        words = texts.take(pa.array(ties)).to_pylist()
        ranks = {w: k for k, w in enumerate(sorted(set(words), key=lambda w: (w is not None, (w or "").encode())))}
        rank[ties] = [ranks[w] for w in words]
        order = np.lexsort([rank, *by[::-1]])
    doc, node, texts = doc[order], node.take(pa.array(order)), texts.take(pa.array(order))
    flat = by[1][order]
    starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1]))) if len(order) else none
    n = np.diff(starts, append=len(order))
    there = np.append(0, np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False)))
    lists = pa.ListArray.from_arrays(pa.array(there[np.append(starts, len(order))], pa.int32()), texts.drop_null())
    return pa.table({"doc": keys.take(pa.array(doc[starts])), "node": node.take(pa.array(starts)), "n": n, "text": pc.binary_join(lists, " ")})


def gathered(nodes: DataFrame, leaves: DataFrame, holds: Column) -> DataFrame:
    """(doc, node, n, text) of the elements that hold content: the texts of all leaves below, by page and number.

    ``leaves(doc, page, mcid, node, text)`` are pieces of content with the tree node they belong to; a piece belongs to its nearest holder. Nodes
    and leaves of a document are shuffled once, as arrays, and holders are found there: memory grows with the longest document.
    """
    own = nodes.where("doc is not null and node is not null").select("doc", "node", "parent", F.coalesce(holds, F.lit(False)).alias("holds"))
    node, doc = (own.schema[c].dataType.simpleString() for c in ("node", "doc"))
    pieces = leaves.where("doc is not null and node is not null").select("doc", F.col("node").cast(node).alias("node"), "page", "mcid", "text")
    return together([own, pieces], "doc", _gathered, f"doc {doc}, node {node}, n long, text string")
