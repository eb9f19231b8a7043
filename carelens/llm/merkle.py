"""Merkle manifest of a table as a persistent, path-copying tree.

A leaf is the sha256 of a row's fields. In each group the leaves stand in the
order of the key; every 8 consecutive nodes become their hash (the last run may
be shorter) until one is left, the group's subroot; the subroots, in the order of
the groups, become the root by the same rule. Hashes go on as lower-case hex.

The tree is built in aligned blocks of 8 ** ``levels`` (4096) nodes: a block lies in one task,
which climbs the levels and hands its top on as a leaf of the next round, so a round
leaves 1/4096 of the nodes and a few rounds reach the subroots. The nodes
that a block's children need from outside (the siblings left and right of them on
every level up to the root) are kept in a table per round: this is what versions
share.

A tampered leaf makes a version of the tree. It shares every untouched node and
copies only the leaf's ancestors: those inside its aligned block in the block's
task, those above from the shared siblings of the block's top, which came to
the same task as one row. So a version costs one hash per level, never a new tree.

Rows are numbered by range partitions of the sorted key (counts before a
partition, per group, plus the place inside it), so a group with a third of all
rows is spread like any other.

Edge cases: null fields count as ``-``; a null group is a group of its own and
the first one; null keys stand first; rows with one key follow the order of their
leaves, equal rows take neighbouring places; a lone leaf is its group's subroot,
a lone group's subroot the root; very long texts are hashed whole; extra columns
are no part of a leaf; an empty table has no rows and no root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.store import buckets_for, stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l:string,r:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in bytes in front."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _h(nodes) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of a block, its own nodes first; ``levels`` are built above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_h(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], i: int) -> list[dict]:
    """Per level below the block's top: what stands left and right of node ``i``'s ancestor in its run."""
    out = []
    for level in tree[:-1]:
        run = i - i % ARITY
        out.append({"l": "".join(level[run:i]), "r": "".join(level[i + 1:run + ARITY])})
        i //= ARITY
    return out


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def copied(node: str, path: list[dict]) -> list[str]:
    """The ancestors of a changed node, lowest first: the copies that its version owns."""
    out = []
    for s in path:
        node = sha256((s["l"] + node + s["r"]).encode()).hexdigest()
        out.append(node)
    return out


def _blocks(batches):
    """Lists of rows (dicts) of one (g, block) each; the rows come sorted by them."""
    rows, key = [], None
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["g"], r["block"])
            if k != key and rows:
                yield rows
                rows = []
            key = k
            rows.append(r)
    if rows:
        yield rows


def _tops(levels: int):
    kind = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])

    def run(batches):
        for rows in _blocks(batches):
            n = rows[0]["n"]
            top = climb([r["h"] for r in rows], min(levels, height(n)))[-1][0]
            yield pa.RecordBatch.from_pylist(
                [{"g": rows[0]["g"], "pos": rows[0]["block"], "n": -(-n // ARITY ** levels), "h": top}], kind)
    return run


_STRUCT = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _paths(levels: int):
    """(g, pos, path) of every child of a block, the path up to the top of the tree:
    the shared siblings of the block's own levels, then the path of its top (``up`` of the first row)."""
    kind = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", _STRUCT)])

    def run(batches):
        for rows in _blocks(batches):
            up, rows = rows[0]["up"], rows[1:]
            tree = climb([r["h"] for r in rows], min(levels, height(rows[0]["n"])))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(
                    [{"g": r["g"], "pos": r["pos"], "path": siblings(tree, lo + i) + up}
                     for i, r in enumerate(rows[lo:lo + 256])], kind)
    return run


def _in_blocks(nodes: DataFrame, size: int, levels: int) -> DataFrame:
    """Nodes dealt by (group, block) and sorted inside a task."""
    n = buckets_for(nodes.sparkSession, size, 64 * ARITY ** levels)
    return nodes.repartition(n, "g", "block").sortWithinPartitions("g", "block", "pos")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY ** levels).cast("long")


def numbered(rows: DataFrame, order: list[str], size: int, per_range: int) -> DataFrame:
    """Add ``pos``, the 0-based place inside group ``g`` by ``order``, and ``n``, the group's size. Stored."""
    ranges = buckets_for(rows.sparkSession, size, per_range)
    rows = rows.repartitionByRange(ranges, "g", *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        "g", *[F.col(c).asc_nulls_first() for c in order])
    # the id holds the range's number and the place inside it
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = rows.groupBy("g", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("start"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("g").alias("run_g"), F.col("part").alias("run_part"),
                       (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("start")).alias("shift"),
                       F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return rows.join(runs, (F.col("g") == F.col("run_g")) & (part == F.col("run_part"))).withColumn(
        "pos", F.col("at") + F.col("shift")).drop("at", "shift", "run_g", "run_part")


def _tree(leaves: DataFrame, size: int, levels: int):
    """(tops, rounds): the top node of each group, (g, h), and the stored nodes (g, pos, n, h, block)
    of each round above the leaves, which are blocks' tops of the round before."""
    kind = "g string, pos long, n long, h string"
    rounds, nodes = [], leaves.select("g", "pos", "n", "h")
    while True:
        tops = stored(_in_blocks(nodes.withColumn("block", _block(levels)), size, levels).mapInArrow(_tops(levels), kind))
        last = tops.agg(F.max("n"), F.count(F.lit(1))).first()
        if (last[0] or 0) <= 1:
            return tops.select("g", "h"), rounds
        rounds.append(tops)
        nodes, size = tops, last[1]


def _upper(rounds: list[DataFrame], extra: DataFrame, levels: int) -> DataFrame:
    """(g, pos, path) of every node of the first of ``rounds`` (of the tops, where it is empty): the
    shared siblings up to the whole tree's root. ``extra`` (g, path) leads from a top to that root."""
    path = extra.select("g", F.lit(0).cast("long").alias("pos"), "path")
    for nodes in reversed(rounds):
        rows = nodes.withColumn("block", _block(levels)).withColumn("up", F.lit(None).cast(PATH)).unionByName(
            path.select("g", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"),
                        F.lit(None).cast("string").alias("h"), F.col("pos").alias("block"), F.col("path").alias("up")))
        path = stored(_in_blocks(rows, nodes.count(), levels).mapInArrow(_paths(levels), f"g string, pos long, path {PATH}"))
    return path


def _versions(key: str, kind: str, levels: int):
    """Proof and version of every leaf: the block's row with ``up`` stands first."""
    def run(batches):
        out_type = pa.schema([(key, pa.int64() if kind == "bigint" else pa.string()),
                              ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                              ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("tampered", pa.string()),
                              ("copied", pa.list_(pa.string()))])
        for rows in _blocks(batches):
            first = rows[0]
            up, rows = first["up"], rows[1:]
            tree = climb([r["h"] for r in rows], min(levels, height(rows[0]["n"])))
            above = "".join(s["l"] + s["r"] for s in up)
            out = []
            for i, r in enumerate(rows):
                path = siblings(tree, i)
                proof = sha256(("".join(s["l"] + s["r"] for s in path) + above).encode()).hexdigest()
                leaf = r["h"] if r["t"] is None else r["t"]
                above_leaf = copied(leaf, path + up)
                out.append({key: r["key"], "leaf": r["h"], "subroot": first["subroot"], "root": first["root"],
                            "proof_sha256": proof, "folded_root": above_leaf[-1] if above_leaf else leaf,
                            "tampered": r["t"], "copied": above_leaf if r["t"] is not None else None})
                if len(out) == 512:
                    yield pa.RecordBatch.from_pylist(out, out_type)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, out_type)
    return run


def _group_paths(levels: int):
    """(group, subroot, root, path from the subroot to the root); the block's row with ``up`` stands first."""
    kind = pa.schema([("g", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", _STRUCT)])

    def run(batches):
        for rows in _blocks(batches):
            first, rows = rows[0], rows[1:]
            tree = climb([r["h"] for r in rows], min(levels, height(rows[0]["n"])))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(
                    [{"g": r["own"], "subroot": r["h"], "root": first["root"], "path": siblings(tree, lo + i) + first["up"]}
                     for i, r in enumerate(rows[lo:lo + 256])], kind)
    return run


def merkle_versions(docs: DataFrame, tampered: dict[str, Column], when: Column, key: str = "doc_id", group: str = "lang",
                    fields: tuple = FIELDS, per_range: int = 200_000, levels: int = 4) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, tampered, copied) of every row.

    ``proof_sha256`` is the hash of the leaf's siblings, level by level to the root. Where ``when``
    holds, the row's fields are replaced by ``tampered``: the new leaf is ``tampered`` and ``copied``
    its version's own nodes, lowest first (none for a tree of one leaf); both are null for other rows.
    ``folded_root`` is the version's root; for a row that is not tampered it is folded from its own leaf."""
    kind = dict(docs.dtypes)[key]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    own = leaf_hash([F.col(c) for c in fields])
    new = F.when(when, leaf_hash([tampered.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"),
                       F.col(key).cast("bigint" if whole else "string").alias("key"), own.alias("h"), new.alias("t"))
    rows = stored(rows)
    size = rows.count()
    leaves = numbered(rows, ["key", "h", "t"], size, per_range)
    leaves = stored(leaves)

    tops, rounds = _tree(leaves, size, levels)
    # the subroots are the leaves of one more tree, in the order of the groups
    groups = tops.count()
    subroots = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("own"), "h"), ["own"], groups, per_range)
    subroots = stored(subroots)
    root, over = _tree(subroots, groups, levels)
    to_root = _upper(over, root.select("g", F.expr(f"cast(array() AS {PATH})").alias("path")), levels)
    rows = subroots.select("g", "pos", "n", "h", "own").withColumn("block", _block(levels)).withColumn(
        "up", F.lit(None).cast(PATH)).withColumn("root", F.lit(None).cast("string"))
    tops_up = to_root.join(root.select("g", F.col("h").alias("root")), "g").select(
        "g", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("h"),
        F.lit(None).cast("string").alias("own"), F.col("pos").alias("block"), F.col("path").alias("up"), "root")
    extra = stored(_in_blocks(rows.unionByName(tops_up), groups, levels).mapInArrow(
        _group_paths(levels), f"g string, subroot string, root string, path {PATH}"))

    upper = _upper(rounds, extra, levels).join(extra.select("g", "subroot", "root"), "g")
    first = upper.select("g", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"),
                         F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("t"),
                         F.lit(None).cast("bigint" if whole else "string").alias("key"), F.col("pos").alias("block"),
                         F.col("path").alias("up"), "subroot", "root")
    rows = leaves.select("g", "pos", "n", "h", "t", "key", _block(levels).alias("block"), F.lit(None).cast(PATH).alias("up"),
                         F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    out = _in_blocks(rows.unionByName(first), size, levels).mapInArrow(
        _versions(key, "bigint" if whole else "string", levels),
        f"{key} {'bigint' if whole else 'string'}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, tampered string, copied array<string>")
    return out.withColumn(key, F.col(key).cast(kind)) if whole and kind != "bigint" else out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def merkle_manifest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows whose crc32(doc_id) is a multiple of 3 are folded from their tampered leaf (text with A-Z
    in lower case), the others from their own, which leads to the root."""
    when = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    v = merkle_versions(docs, {"text": lower_ascii(F.col("text").cast("string"))}, when, **options)
    return v.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))
