"""Merkle dataset manifest: postorder append logs built over aligned blocks, with proofs read at closed-form positions.

A document is a leaf, the digest of its fields. The leaves of a source, by id, are the leaves of its tree, in which every
``ARITY`` consecutive nodes have a parent; the roots of all sources' trees, by source, are the leaves of the tree above them.

A builder takes one aligned block of ``ARITY ** height`` leaves and appends each node to its log as it completes: a leaf,
then every parent whose run it fills. Where a tree has more blocks than one, their roots are the leaves of the next pass,
so a tree of any size is a few passes, each over 2187 times fewer rows, and no task holds more than a block. All nodes of a
level left of a node complete before it, so subtree sizes alone give its position in the log (``position``); proofs are
read from the blocks' logs at those positions: a block's leaves get their siblings from its own log, and all that is above
the block from one row.

Defined results for odd input: each null field is a leaf's ``-``; null source is a tree of its own, first of all; rows that
share an id go by digest, and equal rows have equal leaves at places of their own; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import hashlib
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.llm.ranks import ranked
from caseload.session import stored

#: Children of a node; levels of an aligned block, so that a block has 2187 leaves.
ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof, from the leaf up: at each level the place of the own node in its run, and the run's other nodes.
PATH = "array<struct<place: int, others: array<string>>>"


def digest(parts: list[Column]) -> Column:
    """Lowercase hex sha256 of the parts' concatenated text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Of the fields in order: ``-`` for null, else byte count, colon and value."""
    text = [c.cast("string") for c in fields.values()]
    return digest([F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text])


def combined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return next(h for h in count() if ARITY**h >= n)


def position(level: int, index: int, n: int, top: int) -> int:
    """Where a log of ``n`` leaves and ``top`` levels holds a node: as many nodes as complete before it.

    Below it and on its level are whole subtrees; above it those whose last child is to its left.
    """
    below = sum(min((index + 1) * ARITY ** (level - j), -(-n // ARITY**j)) for j in range(level + 1))
    return below + sum(index // ARITY ** (j - level) for j in range(level + 1, top + 1)) - 1


def appended(leaves: list[str], top: int) -> list[str]:
    """The log of one aligned block: nodes in the order in which they complete, up to level ``top``."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(top + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        runs[level].append(node)
        if level < top and len(runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        add(level + 1, combined(run))

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):
        if runs[level]:
            close(level)
    return log


def levels_of(n: int, size: int, height: int) -> int:
    """Levels that a block of ``n`` leaves is built to: all of them in a tree of more blocks, else until one node is left."""
    return height if size > ARITY**height else height_of(n)


def build(block: pd.DataFrame, height: int) -> pd.DataFrame:
    """The log of a block."""
    block = block.sort_values("place")
    log = appended(list(block["node"]), levels_of(len(block), int(block["size"].iloc[0]), height))
    one = {c: [block[c].iloc[0]] for c in ("tree", "block", "size")}
    return pd.DataFrame({**one, "n": [len(block)], "log": [log], "root": pd.Series([log[-1]], dtype=object)})


def extract(block: pd.DataFrame, above: pd.DataFrame, height: int) -> pd.DataFrame:
    """Each leaf of a block with its proof: siblings at their positions in the block's log, then the path above the block."""
    if not len(block) or not len(above):
        return pd.DataFrame(columns=[*block.columns, "path", "subroot", "top_root"], dtype=object)
    block, up = block.sort_values("place"), above.iloc[0]
    log, n = list(up["log"]), len(block)
    top = levels_of(n, int(block["size"].iloc[0]), height)
    steps: list[list[dict]] = []
    for level in range(top):
        width = -(-n // ARITY**level)
        nodes = [log[position(level, i, n, top)] for i in range(width)]
        steps.append([{"place": i % ARITY, "others": [nodes[k] for k in range(i - i % ARITY, min(i - i % ARITY + ARITY, width)) if k != i]} for i in range(width)])
    rest = [{"place": int(s["place"]), "others": list(s["others"])} for s in up["path"]]
    paths = [[steps[level][i // ARITY**level] for level in range(top)] + rest for i in range(n)]
    return block.assign(path=paths, subroot=up["subroot"], top_root=up["top_root"]).astype({"subroot": object, "top_root": object})


def passes(leaves: DataFrame, height: int) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, logs) of each pass. ``leaves``: tree, place, size, node. ``logs``: tree, block, size, n, log, root."""
    out, nodes, width = [], leaves, ARITY**height
    run = lambda block: build(block, height)
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("place") / width).cast("long"))
        narrow = nodes.select("tree", "block", "place", "size", "node")
        logs = stored(narrow.groupBy("tree", "block").applyInPandas(run, "tree string, block long, size long, n long, log array<string>, root string"))
        out.append((nodes, logs))
        higher = logs.where(F.col("size") > width)
        if higher.isEmpty():
            return out
        nodes = higher.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / width).cast("long").alias("size"), F.col("root").alias("node"))


def tree_roots(built: list[tuple[DataFrame, DataFrame]], height: int) -> DataFrame:
    """(tree, root): the roots of blocks that are whole trees."""
    roots = [logs.where(F.col("size") <= ARITY**height).select("tree", "root") for _, logs in built]
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out


def proven(built: list[tuple[DataFrame, DataFrame]], over: DataFrame, height: int) -> DataFrame:
    """The leaves with path, subroot and top_root. ``over``: the path, subroot and top_root above each tree's root."""
    below, width = None, ARITY**height
    run = lambda block, above: extract(block, above, height)
    for nodes, logs in reversed(built):
        whole = logs.where(F.col("size") <= width).select("tree", "block", "log").join(over, "tree")
        if below is not None:
            parts = logs.where(F.col("size") > width).select("tree", "block", "log")
            whole = whole.unionByName(parts.join(below.select("tree", F.col("place").alias("block"), "path", "subroot", "top_root"), ["tree", "block"]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", path {PATH}, subroot string, top_root string"
        below = nodes.groupBy("tree", "block").cogroup(whole.groupBy("tree", "block")).applyInPandas(run, schema)
    return below.drop("block")


def sealed(docs: DataFrame, more: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, source, leaf, path, subroot, root) for each row of ``docs``, and the further columns ``more``."""
    more = more or {}
    leaf = leaf_digest({c: F.col(c) for c in FIELDS})
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))  # orders as sources do
    rows = stored(docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf.alias("node"), *[c.alias(name) for name, c in more.items()]))
    built = passes(stored(ranked(rows, "tree", ["id", "node"])), height)
    subroots = stored(tree_roots(built, height).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")))
    above = passes(stored(ranked(subroots, "tree", ["name"])), height)
    start = tree_roots(above, height).select("tree", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("root").alias("top_root"))
    over = proven(above, start.withColumn("path", F.array().cast(PATH)), height)
    over = stored(over.select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "top_root"))
    source = F.when(F.col("tree") != "-", F.substring("tree", F.lit(2), F.length("tree")))
    return proven(built, over, height).select(F.col("id").alias("doc_id"), source.alias("source"), F.col("node").alias("leaf"), "path", "subroot", F.col("top_root").alias("root"), *more)


def siblings(path: Column) -> Column:
    """All digests of a proof, from the leaf up, left to right."""
    return F.flatten(F.transform(path, lambda s: s["others"]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    joined = lambda a: F.concat_ws("", a)
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(joined(F.slice(s["others"], F.lit(1), s["place"])), node, joined(F.slice(s["others"], s["place"] + 1, F.size(s["others"])))), 256))


def append_log(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's log: (source, position, digest) of every node of every source's tree, positions gapless from 0.

    A block's node has the position that its level and index in the whole tree give it; levels above the blocks come from
    the next passes' logs, of which all but the leaves are new nodes.
    """
    leaf = leaf_digest({c: F.col(c) for c in FIELDS})
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))
    rows = stored(docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf.alias("node")))
    leaves = stored(ranked(rows, "tree", ["id", "node"]))
    sizes = leaves.groupBy("tree").agg(F.max("size").alias("leaves"))
    out = None
    for k, (_, logs) in enumerate(passes(leaves, height)):
        nodes = logs.join(sizes, "tree").groupBy("tree", "block").applyInPandas(placed_nodes(k, height), "tree string, position long, digest string")
        out = nodes if out is None else out.unionByName(nodes)
    source = F.when(F.col("tree") != "-", F.substring("tree", F.lit(2), F.length("tree")))
    return out.select(source.alias("source"), "position", "digest")


def placed_nodes(pass_no: int, height: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        n, log, leaves = int(r["n"]), list(r["log"]), int(r["leaves"])
        top, whole = levels_of(n, int(r["size"]), height), height_of(leaves)
        at, nodes = [], []
        for level in range(1 if pass_no else 0, top + 1):
            high, first = pass_no * height + level, int(r["block"]) * ARITY ** (height - level)
            for i in range(-(-n // ARITY**level)):
                at.append(position(high, first + i, leaves, whole))
                nodes.append(log[position(level, i, n, top)])
        return pd.DataFrame({"tree": [r["tree"]] * len(at), "position": at, "digest": nodes}).astype({"tree": object, "digest": object})

    return run
