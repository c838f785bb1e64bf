"""Operator 12: a Merkle manifest of a dataset, stored in van Emde Boas layout.

The leaves of a source, in the order of their ids, are the leaves of a tree of arity 3; the roots of all sources are
the leaves of a last tree, whose root stands for the dataset. A tree is cut into aligned subtrees (blocks) of five
levels; the roots of the blocks of one layer are the leaves of the next layer's blocks. Within a block the nodes lie
in van Emde Boas order: the upper half of the levels as one stretch, then each subtree below it as a stretch of its
own, every stretch ordered alike. ``address`` computes a node's place by arithmetic; building a block and fetching
siblings use nothing else.

A block holds at most 243 leaves, so no task and no row grows with a source; a source with most rows is many blocks.
The layers are built upwards, one Spark job each (logarithmically many), and the paths above each block are handed
down in the same way, so proofs of all documents take one pass over the blocks.

Defined results: a null source is the first source; null ids come first in their source, ties (repeated ids) are
ordered by their leaves, and equal rows are leaves of their own; a lone leaf or lone subroot is its own root; an
empty table gives no rows. Other columns than the hashed ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import ranked, saved
from sitegraph.plans.tables import table

ARITY, HEIGHT, DIGEST = 3, 5, 32  # a full block has ARITY ** HEIGHT leaves
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block: its tree, its number in the layer, its leaves' count, its height, its nodes and its root.
BLOCK = "tree long, block long, n int, height int, nodes binary, root binary"
PATH = "tree long, block long, before array<binary>, after array<binary>"


def _nodes(levels: int) -> int:
    """The nodes of a complete tree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes ``index`` at ``depth`` (the root's is 0) of a complete tree."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, width = levels - upper, ARITY ** (depth - upper)
    return _nodes(upper) + index // width * _nodes(lower) + address(lower, depth - upper, index % width)


@lru_cache(maxsize=None)
def places(height: int) -> tuple[tuple[int, ...], ...]:
    """The places of a block's nodes by level above the leaves; there are ``HEIGHT + 1`` heights at most."""
    return tuple(tuple(address(height + 1, height - up, np.arange(ARITY ** (height - up))).tolist()) for up in range(height + 1))


def digest_of(*parts: bytes) -> bytes:
    """The hash of the parts' lower-case hex texts, one after the other."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def height_of(total: int, most: int = HEIGHT) -> int:
    """The levels above the leaves of a block of ``total`` nodes: ``most`` where it is one of several."""
    height = 0
    while height < most and ARITY ** height < total:
        height += 1
    return height


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block; places without a node are zeros."""
    at, out, level = places(height), bytearray(_nodes(height + 1) * DIGEST), leaves
    for up in range(height + 1):
        if up:
            level = [digest_of(*level[i:i + ARITY]) for i in range(0, len(level), ARITY)]
        for i, node in enumerate(level):
            place = at[up][i] * DIGEST
            out[place:place + DIGEST] = node
    return bytes(out)


def node(nodes: bytes, height: int, up: int, index: int) -> bytes:
    place = places(height)[up][index] * DIGEST
    return nodes[place:place + DIGEST]


def siblings(nodes: bytes, n: int, height: int, leaf: int) -> tuple[list[bytes], list[bytes]]:
    """The siblings before and after the way from a leaf to the block's root, one entry a level."""
    before, after = [], []
    for up in range(height):
        first = leaf - leaf % ARITY
        run = range(first, min(first + ARITY, n))
        before.append(b"".join(node(nodes, height, up, i) for i in run if i < leaf))
        after.append(b"".join(node(nodes, height, up, i) for i in run if i > leaf))
        leaf, n = leaf // ARITY, -(-n // ARITY)
    return before, after


def folded(leaf: bytes, before: list[bytes], after: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(before, after):
        leaf = digest_of(left, leaf, right)
    return leaf


def hashed(values: list[Column]) -> Column:
    """H of a row: every value with its UTF-8 byte count before it, ``-`` for null; as 32 bytes."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


def _block_batches(batches: Iterator[pa.RecordBatch], extra: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows ``tree, pos, total, digest`` that come block by block, in order; ``extra`` columns become lists."""
    held: list[tuple] = []
    span = ARITY ** most

    def block() -> pa.RecordBatch:
        tree, pos, total, _ = held[0][:4]
        leaves = [r[3] for r in held]
        height = height_of(total, most)
        nodes = build(leaves, height)
        values = [tree, pos // span, len(leaves), height, nodes, node(nodes, height, height, 0), *([r[4 + i] for r in held] for i in range(len(extra)))]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *(pa.list_(kinds[c]) for c in extra)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["tree", "block", "n", "height", "nodes", "root", *extra])

    kinds: dict[str, pa.DataType] = {}
    for batch in batches:
        kinds = {f.name: f.type for f in batch.schema}
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "pos", "total", "digest", *extra))):
            if held and (row[0] != held[0][0] or row[1] // span != held[0][1] // span):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def layer(rows: DataFrame, name: str, height: int, extra: str = "") -> DataFrame:
    """The written blocks of ``rows(tree, pos, total, digest)``, ``total`` being the tree's rows in this layer."""
    names = [c.split()[0] for c in extra.split(", ")] if extra else []
    lists = "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in extra.split(", ")) if extra else ""
    dealt = rows.withColumn("_block", F.expr(f"pos div {ARITY ** height}")).repartition("tree", "_block").sortWithinPartitions("tree", "pos").drop("_block")
    return saved(dealt.mapInArrow(lambda batches: _block_batches(batches, names, height), BLOCK + lists), name)


def upper_layers(blocks: DataFrame, height: int) -> list[DataFrame]:
    """All layers from ``blocks`` on, until every tree is one block."""
    layers = [blocks]
    while not layers[-1].where("block > 0").isEmpty():
        last = layers[-1].select("tree", "block", "root")
        totals = last.groupBy("tree").agg(F.count("*").alias("total")).where("total > 1")
        roots = last.join(totals, "tree").select("tree", F.col("block").alias("pos"), "total", F.col("root").alias("digest"))
        layers.append(layer(roots, "merkle-layer", height))
    return layers


def tops(layers: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree: that of its only block in its last layer."""
    out, above = None, None
    for blocks in reversed(layers):
        last = blocks.select("tree", "root") if above is None else blocks.select("tree", "root").join(above, "tree", "left_anti")
        out = last if out is None else out.unionByName(last)
        above = blocks.select("tree").distinct()
    return out


def _descend_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each leaf of each block (a block of the layer below), the siblings from it up to the root above."""
    span = ARITY ** most
    for batch in batches:
        for tree, block, n, height, nodes, before, after in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "height", "nodes", "before", "after"))):
            own = [siblings(nodes, n, height, i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * n, pa.int64()), pa.array(range(block * span, block * span + n), pa.int64()),
                 pa.array([b + before for b, _ in own], pa.list_(pa.binary())), pa.array([a + after for _, a in own], pa.list_(pa.binary()))],
                names=["tree", "block", "before", "after"])


def descend(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """``PATH`` of every leaf of ``blocks``, given the paths ``above`` the blocks."""
    return blocks.join(above, ["tree", "block"]).mapInArrow(lambda batches: _descend_batches(batches, height), PATH)


def paths(layers: list[DataFrame], height: int, above: DataFrame | None = None) -> DataFrame:
    """``PATH``: the siblings above each block of the first layer, up to the trees' roots and on along ``above``
    (``tree, before, after``; default: nothing above)."""
    none = F.array().cast("array<binary>")
    given = None
    for k in range(len(layers) - 1, -1, -1):
        blocks = layers[k]
        top = blocks.select("tree", "block")
        if given is not None:  # trees with a block above take their paths from it
            top = top.join(given.select("tree").distinct(), "tree", "left_anti")
        if above is None:
            top = top.select("tree", "block", none.alias("before"), none.alias("after"))
        else:
            top = top.join(above, "tree").select("tree", "block", "before", "after")
        if given is not None:
            top = top.unionByName(given)
        if k == 0:
            return top
        given = saved(descend(blocks, top, height), "merkle-paths")
    raise ValueError("no layers")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", tampered: Column | None = None, height: int = HEIGHT) -> dict:
    """The written layers of the manifest of ``docs``: ``groups`` (per tree: its group), ``layers`` (the groups' trees;
    the first layer's blocks also list the rows' keys and the leaves of their ``tampered`` texts, if given), ``top``
    (the layers of the last tree, whose leaves are the subroots) and the ``height`` of full blocks."""
    leaf = hashed([F.col(c) for c in columns])
    other = F.lit(None).cast("binary") if tampered is None else hashed([tampered if c == "text" else F.col(c) for c in columns])
    changed = F.lit(False) if tampered is None else ~F.col("text").eqNullSafe(tampered)
    leaves = saved(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("digest"), F.when(changed, other).alias("tampered")), "merkle-leaves")
    salted = leaves.withColumn("_salt", F.monotonically_increasing_id())  # equal rows may be split between tasks
    order = ranked(salted, [F.col("group"), F.col("key"), F.col("digest"), F.col("_salt")], "rank", "merkle-order")
    sizes = order.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("total"))
    groups = saved(ranked(saved(sizes, "merkle-sizes"), [F.col("first")], "tree", "merkle-groups"), "merkle-trees")
    rows = order.alias("r").join(groups.alias("g"), F.col("r.group").eqNullSafe(F.col("g.group"))).select(
        F.col("g.tree").alias("tree"), (F.col("r.rank") - F.col("g.first")).alias("pos"), "g.total", "r.digest", F.col("r.key").alias("keys"), "r.tampered")
    layers = upper_layers(layer(rows, "merkle-blocks", height, "keys long, tampered binary"), height)
    total = groups.count()
    subroots = tops(layers).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(total).cast("long").alias("total"), F.col("root").alias("digest"))
    return {"groups": groups, "layers": layers, "top": upper_layers(layer(subroots, "merkle-top", height), height), "height": height}


def _prove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("n", "height", "nodes", "before", "after", "keys", "tampered", "subroot", "top")
    for batch in batches:
        for n, height, nodes, before, after, keys, tampered, subroot, top in zip(*(batch.column(c).to_pylist() for c in columns)):
            out = []
            for i in range(n):
                own_before, own_after = siblings(nodes, n, height, i)
                left, right = own_before + before, own_after + after
                leaf = node(nodes, height, 0, i)
                proof = digest_of(*(x for pair in zip(left, right) for x in pair))
                to = folded(tampered[i] or leaf, left, right)
                out.append((keys[i], leaf.hex(), subroot.hex(), top.hex(), proof.hex(), to.hex(), to == top))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 5, pa.bool_()])],
                                             names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


PROOF = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(made: dict) -> DataFrame:
    """Per row of a manifest: its leaf, the roots, the digest of its proof, and the root that its (tampered) leaf and
    the proof lead to (``PROOF``)."""
    layers, top, height = made["layers"], made["top"], made["height"]
    last = descend(top[0], paths(top, height), height)
    above = last.select(F.col("block").alias("tree"), "before", "after")  # the last tree's leaves are the trees
    subroots = tops(layers).withColumnRenamed("root", "subroot")
    whole = tops(top).select(F.col("root").alias("top"))
    trees = saved(above.join(subroots, "tree"), "merkle-above")
    root = whole.first()
    blocks = layers[0].drop("root").join(paths(layers, height, trees.drop("subroot")), ["tree", "block"]).join(trees.select("tree", "subroot"), "tree")
    return blocks.withColumn("top", F.lit(bytes(root["top"]) if root else b"")).mapInArrow(_prove_batches, PROOF)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; line breaks are deleted from the tampered texts (ids with an even crc32)."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return prove(manifest(docs, tampered=tampered)).withColumnRenamed("key", "doc_id")


def _crc32(value: str) -> str:
    """DuckDB SQL for the crc32 of a text of one-byte characters: every byte is mixed in, then eight shifts."""
    steps = f"flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({value}, '')])"
    step = "CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [y::BIGINT FOR y IN {steps}]), lambda s, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents),
l AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM d),
tree AS (
  SELECT 0 AS up, t, i, leaf AS h, n FROM l
  UNION ALL
  SELECT up + 1, t, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY up, t, i // 3, n),
subroots AS (SELECT t, h FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS up, t AS i, h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT up + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY up, i // 3, n),
ways AS (
  SELECT l.r, v.up AS k, l.t, l.i // CAST(3 ** v.up AS BIGINT) AS i FROM l JOIN (SELECT DISTINCT t, up FROM tree WHERE n > 1) v ON v.t = l.t
  UNION ALL
  SELECT l.r, 1000 + v.up, NULL, l.t // CAST(3 ** v.up AS BIGINT) FROM l CROSS JOIN (SELECT DISTINCT up FROM top WHERE n > 1) v),
nodes AS (SELECT up AS k, t, i, h FROM tree UNION ALL SELECT 1000 + up, NULL, i, h FROM top),
steps AS (
  SELECT w.r, row_number() OVER (PARTITION BY w.r ORDER BY w.k) - 1 AS k,
         coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < w.i), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > w.i), '') AS after
  FROM ways w JOIN nodes s ON s.k = w.k AND s.t IS NOT DISTINCT FROM w.t AND s.i // 3 = w.i // 3 GROUP BY w.r, w.k, w.t, w.i),
folds AS (
  SELECT r, 0 AS k, changed AS h FROM l
  UNION ALL
  SELECT f.r, f.k + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN steps s ON s.r = f.r AND s.k = f.k),
ends AS (SELECT r, arg_max(h, k) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT l.r, sha256(coalesce(string_agg(s.before || s.after, '' ORDER BY s.k), '')) AS proof_sha256 FROM l LEFT JOIN steps s ON s.r = l.r GROUP BY l.r)
SELECT l.doc_id, l.leaf, u.h AS subroot, m.h AS root, p.proof_sha256, e.folded_root, e.folded_root = m.h AS verified
FROM l JOIN subroots u ON u.t = l.t JOIN (SELECT h FROM top WHERE n = 1) m ON true JOIN proofs p ON p.r = l.r JOIN ends e ON e.r = l.r
"""
