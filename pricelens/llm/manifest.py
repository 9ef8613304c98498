"""A Merkle manifest of documents, and what each tampered document would make of it.

Every row is a leaf. The leaves of a language, in order of their ids, are the lowest nodes of its tree of
fan-out ``FAN``; the languages' roots are the leaves of one more such tree.

1. Leaves are hashed next to the text; only digests travel on. Positions come from ranges of (language, id)
   and the running counts of the ranges, so a language that holds a third of all rows isn't one group.
2. An aligned block of ``FAN ** DEEP`` consecutive leaves is a persistent tree in one task. Its root is one
   node for the next round, which does the same with 4,096 times fewer nodes, until one is left per tree.
3. Then the blocks are visited once more, each with the siblings of its path up to the manifest's root. A
   tampered leaf makes a new version of the block's tree: only the leaf's ancestors are copied, all other
   nodes are shared with the untampered version. The version goes on above the block by copies of the upper
   ancestors alone, made from the path's siblings; no two versions meet, and none waits for another.

Null values count as ``-``, a null language comes first, null ids come before others and aren't tampered
with. Rows of equal ids are ordered by their leaves, so repeated rows are leaves of their own. An empty table
has no leaves and no result. Other columns aren't read; a text of any length is hashed where it lies.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, stored

FAN, DEEP = 8, 4
#: A row in as many is tampered with, by the CRC-32 of its decimal id.
EVERY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """How often n nodes become ``FAN`` times fewer until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


class Versions:
    """A persistent tree: nodes are only ever added, and a version is the number of its root."""

    def __init__(self, leaves: list[str], height: int):
        self.hash, self.kids, self.height = list(leaves), [()] * len(leaves), height
        row = list(range(len(leaves)))
        for _ in range(height):
            row = [self._node(tuple(row[k:k + FAN])) for k in range(0, len(row), FAN)]
        self.root, = row

    def _node(self, kids: tuple[int, ...]) -> int:
        self.hash.append(digest([self.hash[k] for k in kids]))
        self.kids.append(kids)
        return len(self.hash) - 1

    def path(self, root: int, at: int) -> list[tuple[int, int]]:
        """(node, place of the child) from the root down to the parent of leaf ``at``."""
        out = []
        for level in range(self.height - 1, -1, -1):
            place = at // FAN**level % FAN
            out.append((root, place))
            root = self.kids[root][place]
        return out

    def put(self, root: int, at: int, leaf: str) -> int:
        """The version with another leaf: copies of its ancestors, everything else shared."""
        path = self.path(root, at)
        self.hash.append(leaf)
        self.kids.append(())
        new = len(self.hash) - 1
        for node, place in reversed(path):
            kids = self.kids[node]
            new = self._node((*kids[:place], new, *kids[place + 1:]))
        return new

    def siblings(self, root: int, at: int) -> list[tuple[str, str]]:
        """The siblings left and right of the path, from the leaf's level up."""
        out = []
        for node, place in reversed(self.path(root, at)):
            hashes = [self.hash[k] for k in self.kids[node]]
            out.append(("".join(hashes[:place]), "".join(hashes[place + 1:])))
        return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node has under a path of siblings."""
    for left, right in path:
        node = digest([left, node, right])
    return node


def leaf(fields: dict[str, F.Column]):
    """The leaf's digest: each field by its byte count and value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, other): digests of the row as it is and, where it is tampered with, as it would be."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    upper = "".join(map(chr, range(65, 91)))
    other = {**fields, "text": F.translate(fields["text"], upper, upper.lower())}
    hit = F.crc32(fields["doc_id"].cast("string").cast("binary")) % EVERY == 0
    # the tree's name: empty for a null language, so that it comes first
    tree = F.coalesce(F.concat(F.lit("="), fields["lang"].cast("string")), F.lit(""))
    return docs.select(fields["doc_id"].cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(leaf(fields)).alias("leaf"),
                       F.when(hit, F.unhex(leaf(other))).alias("other"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``at``, the place of each row in its tree by ``order``, and ``n``, the tree's size.

    Rows are sorted by ranges; the places follow from the counts of the ranges before, one row for each
    tree in each range.
    """
    ranged = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("mark", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("mark", 33))
    counts = ranged.groupBy("tree", "part").agg(F.min("mark").alias("first"), F.count("*").alias("rows"))
    w = W.partitionBy("tree")
    before = F.sum("rows").over(w.orderBy("part")) - F.col("rows")
    counts = stored(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n")), "counts")
    return ranged.join(counts, ["tree", "part"]).withColumn("at", F.col("mark") + F.col("shift")).drop("mark", "part", "shift")


def height(n: int, deep: int) -> int:
    return min(deep, levels(n))


def _in_order(t: pa.Table, *columns: str):
    t = t.sort_by("at")
    return [t.column(c).to_pylist() for c in columns]


def _root(deep: int):
    span = FAN**deep

    def run(t: pa.Table) -> pa.Table:
        (hashes,) = _in_order(t, "leaf")
        n = t.column("n")[0].as_py()
        tree = Versions([h.hex() for h in hashes], height(n, deep))
        return pa.table({"tree": t.column("tree")[:1].cast(pa.string()), "at": t.column("block")[:1], "leaf": pa.array([bytes.fromhex(tree.hash[tree.root])]),
                         "n": pa.array([-(-n // span)])})

    return run


STEP = "struct<left: string, right: string>"
ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(deep: int):
    span = FAN**deep

    def run(t: pa.Table) -> pa.Table:
        at, hashes = _in_order(t, "at", "leaf")
        tree = Versions([h.hex() for h in hashes], height(t.column("n")[0].as_py(), deep))
        path = [[{"left": a, "right": b} for a, b in tree.siblings(tree.root, p % span)] for p in at]
        name = t.column("tree")[0].as_py()
        return pa.table({"tree": pa.array([name] * len(at), pa.string()), "at": pa.array(at), "block": pa.array([p // span for p in at]), "path": pa.array(path, ARROW_PATH)})

    return run


def blocks(nodes: DataFrame, deep: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / FAN**deep))


def roots(nodes: DataFrame, deep: int) -> DataFrame:
    """One node (tree, at, leaf, n) for each block of nodes."""
    return blocks(nodes, deep).select("tree", "block", "at", "leaf", "n").groupBy("tree", "block").applyInArrow(_root(deep), "tree string, at long, leaf binary, n long")


def climb(nodes: DataFrame, deep: int) -> DataFrame:
    """(tree, at, path, top): the siblings up to the tree's root, and that root, of each node (tree, at, leaf, n)."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(stored(roots(rounds[-1], deep), "round"))
    out = rounds[-1].select("tree", "at", F.array().cast(f"array<{STEP}>").alias("path"), F.col("leaf").alias("top"))
    for below in reversed(rounds[:-1]):
        own = blocks(below, deep).select("tree", "block", "at", "leaf", "n").groupBy("tree", "block").applyInArrow(_paths(deep), f"tree string, at long, block long, path array<{STEP}>")
        above = out.select("tree", F.col("at").alias("block"), F.col("path").alias("rest"), "top")
        out = own.join(above, ["tree", "block"]).select("tree", "at", F.concat("path", "rest").alias("path"), "top")
    return out


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(deep: int):
    span = FAN**deep

    def run(docs: pa.Table, path: pa.Table) -> pa.Table:
        at, ids, hashes, others = _in_order(docs, "at", "doc_id", "leaf", "other")
        up = [(s["left"], s["right"]) for s in path.column("path")[0].as_py()]
        subroot, root = path.column("subroot")[0].as_py().hex(), path.column("root")[0].as_py().hex()
        tree = Versions([h.hex() for h in hashes], height(docs.column("n")[0].as_py(), deep))
        same, rest, rows = folded(tree.hash[tree.root], up), "".join(a + b for a, b in up), []
        for k, (p, other) in enumerate(zip(at, others, strict=True)):
            proof = digest([*[a + b for a, b in tree.siblings(tree.root, p % span)], rest])
            got = same if other is None else folded(tree.hash[tree.put(tree.root, p % span, other.hex())], up)
            rows.append((ids[k], hashes[k].hex(), subroot, root, proof, got, got == root))
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return run


def manifest(docs: DataFrame, deep: int = DEEP) -> DataFrame:
    """The result's rows; ``deep``: levels of a block's tree in one task."""
    prepare(docs.sparkSession)
    placed = blocks(positions(stored(leaves(docs), "leaves"), ["doc_id", "leaf"]), deep)
    placed = stored(placed, "placed")
    nodes = stored(roots(placed, deep), "roots")
    upper = climb(nodes, deep)
    upper = stored(upper.withColumnRenamed("top", "subroot"), "upper")
    langs = stored(upper.where("at = 0").select("tree", F.col("subroot").alias("leaf")), "subroots")
    top = positions(langs.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf"), ["name"])
    top = stored(top, "top")
    over = climb(top.select("tree", "at", "leaf", "n"), deep).join(top.select("at", "name"), "at")
    over = stored(over.select(F.col("name").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root")), "over")
    paths = upper.join(over, "tree").select("tree", F.col("at").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root")
    return placed.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(_verify(deep), RESULT)


def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    return manifest(docs)


def _sql() -> str:
    """DuckDB: one level a step, as many as SQL needs for 8 ** 7 rows a language and 8 ** 3 languages."""
    out = [r"""t AS (SELECT list(v ORDER BY k) AS tbl FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(k)))"""]
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hashed = lambda text: "sha256(" + " || ".join(field(c) for c in [*FIELDS[:-1], text]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295)"
    out.append(f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {hashed('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % {EVERY} = 0 THEN {hashed(lower)} END AS other FROM documents, t)")
    out.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h, coalesce(other, leaf) AS f, '' AS proof FROM d)")

    def step(source: str, name: str, by: str, at: str, n: str, steps: int, first: str) -> str:
        """Nodes of each level as a table of their own; ``source`` rows climb along."""
        nodes = f"{name}n0 AS (SELECT DISTINCT {by} AS tree, {at} AS pos, {n} AS n, {first} AS h FROM {source})"
        parts, rows = [nodes], source
        for k in range(steps):
            parts.append(f"{name}n{k + 1} AS (SELECT tree, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}n{k} GROUP BY tree, pos // 8)")
            parts.append(f"{name}s{k} AS (SELECT x.tree, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r FROM {name}n{k} x JOIN {name}n{k} y ON y.tree = x.tree AND y.pos // 8 = x.pos // 8 GROUP BY x.tree, x.pos)")
            parts.append(f"{name}{k} AS (SELECT a.* REPLACE (a.{at} // 8 AS {at}, (a.{n} + 7) // 8 AS {n}, CASE WHEN a.{n} > 1 THEN sha256(s.l || a.f || s.r) ELSE a.f END AS f, a.proof || CASE WHEN a.{n} > 1 THEN s.l || s.r ELSE '' END AS proof) FROM {rows} a JOIN {name}s{k} s ON s.tree = a.{by} AND s.pos = a.{at})")
            rows = f"{name}{k}"
        return ", ".join(parts)

    out.append(step("a0", "g", "tree", "pos", "n", 7, "leaf"))
    out.append("b0 AS (SELECT g6.doc_id, g6.leaf, g6.f, g6.proof, z.h AS subroot, '' AS one, dense_rank() OVER (ORDER BY g6.tree) - 1 AS la, (SELECT count(*) FROM gn7) AS ln FROM g6 JOIN gn7 z ON z.tree = g6.tree)")
    out.append(step("b0", "k", "one", "la", "ln", 3, "subroot"))
    return "WITH " + ", ".join(out) + " SELECT doc_id, leaf, subroot, z.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = z.h AS verified FROM k2, kn3 z"


SQL = _sql()
