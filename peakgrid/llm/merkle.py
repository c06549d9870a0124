"""A Merkle manifest of a table: a digest of each row, a tree of them per source, one root, and a proof for each row.

Rows are ranked within their source without gathering one: a sort by ranges, and one count per range and source. Aligned blocks of
4,096 leaves are whole subtrees. A recursive traversal of a block, children first, returns the subtree's digest and, while it unwinds, appends each
child's siblings to the leaves that the child contains. The blocks' digests are the leaves of the next, smaller traversal, and so on
until one node is left of each source; the sources' digests go the same way. Then the traversals are run once more from the top down: a block starts
with the path above it, which stands before its leaves as one row, so that no proof is ever shipped for each leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import running
from . import common
from .native import LOWER, UPPER

#: Fixed value: children of a node.
WIDTH = 16
#: Levels of the tree within one block, which so holds 4,096 leaves.
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of a path: the node's place among its run, and the others' digests in a row.
PATH = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("others", T.StringType())]))

Path = list[tuple[int, str]]


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int, depth: int) -> int:
    """Levels above n nodes until one is left, depth at most."""
    k = 0
    while n > 1 and k < depth:
        n, k = -(-n // WIDTH), k + 1
    return k


def traverse(digests: list[str], height: int, paths: list[Path] | None = None) -> str:
    """The digest of the subtree of this height over digests; paths, one for each of them, get its levels appended, the lowest first."""

    def visit(low: int, level: int) -> str:
        if not level:
            return digests[low]
        step = WIDTH ** (level - 1)
        high = min(low + step * WIDTH, len(digests))
        kids = [visit(i, level - 1) for i in range(low, high, step)]
        if paths is not None:
            for j, i in enumerate(range(low, high, step)):
                here = (j, "".join(kids[:j] + kids[j + 1 :]))
                for leaf in range(i, min(i + step, high)):
                    paths[leaf].append(here)
        return h("".join(kids))

    return visit(0, height)


def fold(digest: str, path: Path) -> str:
    """The root that a leaf and its path lead to."""
    for at, others in path:
        digest = h(others[: 64 * at] + digest + others[64 * at :])
    return digest


def leaf(text: F.Column) -> F.Column:
    """H of the fields, with this as the text: `-` for null, else UTF-8 byte count, `:` and value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(F.col(f).cast("string")) for f in FIELDS[:-1]], part(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """A table (doc_id, source, leaf, tampered, k, n): k the leaf's rank in its source from 0, n the source's leaves; tampered is null where it is the leaf."""
    src = common.pick(docs, *FIELDS)
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    made = src.select("doc_id", F.col("source").cast("string").alias("source"), leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))
    made = common.table(made).withColumn("row", F.monotonically_increasing_id())
    order = ["source", "doc_id", "leaf", "row"]
    run = made.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    run = common.table(run.withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    held = run.groupBy("source", "part").agg(F.min("own").alias("first"), F.count("*").alias("m"))  # of each source a row per range
    w = Window.partitionBy("source")
    held = held.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.sum("m").over(w.orderBy("part")) - F.col("m") - F.col("first")).alias("lift"), F.sum("m").over(w).alias("n"))
    both = run.join(held, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return both.select("doc_id", "source", "leaf", "tampered", (F.col("own") + F.col("lift")).alias("k"), "n")


def by_block(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """fn of the rows of each block, in the order of k; rows begins with (g, block, k). Blocks share Arrow batches; no more than a batch and a block are held."""
    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        key: tuple | None = None
        for b in batches:
            g, block = b.column(0).to_pylist(), b.column(1).to_numpy()
            changed = np.fromiter((x != y for x, y in zip(g[1:], g, strict=False)), bool, len(g) - 1) | (block[1:] != block[:-1]) if len(g) else np.zeros(0, bool)
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()][: len(g)]
            for s, e in zip(starts, [*starts[1:], len(g)], strict=True):
                now = (g[s], int(block[s]))
                if rest and now != key:
                    yield from fn(pa.Table.from_batches(rest)).to_batches()
                    rest = []
                key = now
                rest.append(b.slice(s, e - s))
        if rest:
            yield from fn(pa.Table.from_batches(rest)).to_batches()

    return dealt.mapInArrow(run, schema)


def roots(nodes: DataFrame, depth: int) -> DataFrame:
    """A table (g, k, digest, n) of the blocks of nodes, which has these columns: the next round's nodes."""
    schema = T.StructType([nodes.schema["g"], T.StructField("k", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n")[0].as_py()
        digest = traverse(t.column("digest").to_pylist(), levels(n, depth))
        return pa.table({"g": t.column("g").slice(0, 1), "k": t.column("block").slice(0, 1), "digest": [digest], "n": pa.array([-(-n // WIDTH**depth)], pa.int64())})

    return common.table(by_block(nodes.select("g", block(depth), "k", "digest", "n"), run, schema))


def block(depth: int) -> F.Column:
    return F.expr(f"k div {WIDTH**depth}").alias("block")


def rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """nodes, their blocks, the blocks of these, and so on until each group has one node: a round for each factor of a block's leaves."""
    out = [nodes, roots(nodes, depth)]
    while out[-1].agg(F.max("k")).first()[0]:
        out.append(roots(out[-1], depth))
    return out


def unwind(nodes: DataFrame, above: DataFrame, depth: int, keep: list[str], fn: Callable[[pa.Table, list[Path], dict], dict], schema: T.StructType, extra: list[str] | None = None) -> DataFrame:
    """fn of each block's nodes, their paths to the top, and the columns extra of the block's row in above: (g, k, path, *extra)."""
    extra = extra or []
    kinds = {c: nodes.schema[c].dataType for c in keep} | {c: above.schema[c].dataType for c in extra}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = nodes.select("g", block(depth), "k", "digest", "n", F.lit(None).cast(PATH).alias("path"), *keep, *[none(c) for c in extra])
    head = above.select("g", F.col("k").alias("block"), F.lit(-1).cast("long").alias("k"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n"), "path", *[none(c) for c in keep], *extra)

    def run(t: pa.Table) -> pa.Table:
        first, t = t.slice(0, 1).to_pylist()[0], t.slice(1)
        digests, n = t.column("digest").to_pylist(), t.column("n")[0].as_py()
        paths: list[Path] = [[] for _ in digests]
        traverse(digests, levels(n, depth), paths)
        rest = [(x["at"], x["others"]) for x in first["path"]]
        return pa.table(fn(t, [p + rest for p in paths], first))

    return by_block(rows.unionByName(head), run, schema)


def column(found: list[Path]) -> pa.Array:
    return pa.array([[{"at": a, "others": o} for a, o in p] for p in found], pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])))


def paths(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """A table (g, k, path) of the paths of nodes, from those of their blocks."""
    schema = T.StructType([nodes.schema["g"], T.StructField("k", T.LongType()), T.StructField("path", PATH)])

    def fn(t: pa.Table, found: list[Path], _: dict) -> dict:
        return {"g": t.column("g"), "k": t.column("k"), "path": column(found)}

    return common.table(unwind(nodes, above, depth, [], fn, schema))


def down(tree: list[DataFrame], top: DataFrame, depth: int) -> DataFrame:
    """(g, k, path) of the blocks of a tree's first round, from the paths (g, k = 0, path) of its groups."""
    for nodes in reversed(tree[1:-1]):
        top = paths(nodes, top, depth)
    return top


def manifest(docs: DataFrame, with_proof: bool = False, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) per row of docs; proof is the path from the leaf to the root, as fold() takes it.

    Nulls are fields of their own (`-`); a null source is a source, the first one, and rows with a null doc_id come first in theirs. They aren't
    tampered with. Rows of one source and doc_id, the ties, go by their leaf; repeated rows follow each other, each with a proof of its own. An
    empty text is `0:`, texts of any length are hashed whole by Spark. An empty table gives no rows. Other columns of docs, whatever their
    names, are left alone.
    """
    rows = common.table(leaves(docs))
    nodes = rows.select(F.col("source").alias("g"), "k", F.col("leaf").alias("digest"), "n", "doc_id", "tampered")
    tree = rounds(nodes, depth)
    subroots = tree[-1].select("g", F.col("digest").alias("subroot"))
    placed = running(subroots.withColumn("one", F.lit(1)), ["g"], {"upto": "one"})
    many = subroots.count()
    named = common.table(placed.select(F.lit(0).alias("g"), (F.col("upto") - 1).cast("long").alias("k"), F.col("subroot").alias("digest"), F.lit(many).cast("long").alias("n"), F.col("g").alias("source")))
    over = rounds(named, depth)
    root = over[-1].first()
    root = root and root["digest"]
    start = over[-1].select("g", "k", F.array().cast(PATH).alias("path"))
    top = paths(named, down(over, start, depth), depth).join(named.select("k", "source", F.col("digest").alias("subroot")), "k")
    top = top.select(F.col("source").alias("g"), F.lit(0).cast("long").alias("k"), "path", "subroot")
    low = down(tree, top.drop("subroot"), depth)
    low = low.join(top.select(F.col("g").alias("_g"), "subroot"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")], *[T.StructField("proof", PATH)] * with_proof])

    def fn(t: pa.Table, found: list[Path], first: dict) -> dict:
        digests = t.column("digest").to_pylist()
        begun = [b or a for a, b in zip(digests, t.column("tampered").to_pylist(), strict=True)]
        proof = [h("".join(o for _, o in p)) for p in found]
        made = {"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "subroot": pa.array([first["subroot"]] * len(digests)), "proof_sha256": proof, "folded_root": [fold(d, p) for d, p in zip(begun, found, strict=True)]}
        return made | ({"proof": column(found)} if with_proof else {})

    out = unwind(nodes, low, depth, ["doc_id", "tampered"], fn, schema, ["subroot"])
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"), *["proof"] * with_proof)



_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_PART.format(f) for f in FIELDS[:-1])
_OTHERS = "array_to_string(list_concat(kids[1:w.k % 16], kids[w.k % 16 + 2:]), '')"
_UP = "sha256(array_to_string(list_concat(list_concat(kids[1:w.k % 16], [w.node]), kids[w.k % 16 + 2:]), ''))"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"

#: The tree level by level, and each row's way up by joins.
SQL = f"""WITH RECURSIVE doc AS (SELECT *, sha256(head || {_PART.format("text")}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256(head || {_PART.format("translate(text, '" + UPPER + "', '" + LOWER + "')")}) END AS tampered
 FROM (SELECT doc_id, source, text, {_HEAD} AS head, {_CRC} AS crc FROM documents)),
ranked AS (SELECT doc_id, source, leaf, coalesce(tampered, leaf) AS start, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS rid FROM doc),
tree AS (SELECT 0 AS lv, source, k, n, leaf AS digest FROM ranked
 UNION ALL SELECT lv + 1, source, k // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY k)) FROM tree WHERE n > 1 GROUP BY lv, source, k // 16, n),
sub AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lv, k, n, digest FROM sub
 UNION ALL SELECT lv + 1, k // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY k)) FROM top WHERE n > 1 GROUP BY lv, k // 16, n),
run AS (SELECT lv, source, k // 16 AS r, list(digest ORDER BY k) AS kids FROM tree WHERE n > 1 GROUP BY ALL),
trun AS (SELECT lv, k // 16 AS r, list(digest ORDER BY k) AS kids FROM top WHERE n > 1 GROUP BY ALL),
w1 AS (SELECT rid, source, 0 AS lv, k, n, start AS node, '' AS proof FROM ranked
 UNION ALL SELECT rid, w.source, w.lv + 1, w.k // 16, (w.n + 15) // 16, {_UP}, proof || {_OTHERS} FROM w1 AS w JOIN run ON run.lv = w.lv AND run.r = w.k // 16 AND run.source IS NOT DISTINCT FROM w.source),
w2 AS (SELECT rid, 0 AS lv, sub.k, sub.n, node, proof FROM w1 JOIN sub ON w1.source IS NOT DISTINCT FROM sub.source WHERE w1.n = 1
 UNION ALL SELECT rid, w.lv + 1, w.k // 16, (w.n + 15) // 16, {_UP}, proof || {_OTHERS} FROM w2 AS w JOIN trun ON trun.lv = w.lv AND trun.r = w.k // 16)
SELECT ranked.doc_id, ranked.leaf, sub.digest AS subroot, top.digest AS root, sha256(w2.proof) AS proof_sha256, w2.node AS folded_root, w2.node = top.digest AS verified
FROM ranked JOIN sub ON ranked.source IS NOT DISTINCT FROM sub.source JOIN w2 ON w2.rid = ranked.rid AND w2.n = 1 CROSS JOIN (SELECT digest FROM top WHERE n = 1) AS top"""
