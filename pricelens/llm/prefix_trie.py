"""The trie of conversation prefixes, built from adaptive radix trees over fixed-width turn ids.

1. A turn's id is 20 bytes: 16 of the SHA-256 of role and text (the role's length first), then the count
   of the text's words, big-endian. A conversation's key is the ids of its turns, one after the other.
   Texts leave the plan here; from now on a turn costs 20 bytes.
2. Keys are dealt out by ranges of (key, conversation), so a first turn that a third of all conversations
   share, or a third that are equal throughout, spreads over many runs. Each run is a contiguous stretch of
   the sorted keys and becomes one adaptive radix tree: nodes of 4, 16, 48 or 256 children that grow as they
   fill, and paths without a branch kept as one compressed label. Only byte depths that end a turn's id emit
   a node of the trie.
3. Two neighbouring runs share exactly the nodes on the common prefix of the keys at their border. A node is
   owned by the first run that has it and settled by the last; with the lengths of the common prefixes on
   both sides, every figure of a run can be added to those of the other runs. So all nodes but those on a
   border's prefix are final within their run, and these few are summed.

Rows with a null ``conv_id`` belong to no conversation. Turns of equal number are ordered by their ids.
A table without conversations has no nodes. Repeated rows are turns of their own. Other columns aren't read.
A key is one value, so a conversation may have 100 million turns (Spark's limit of 2 GB a value).
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, shared_prefix, stored

#: Bytes of a turn's id, of which the last four count its words.
WIDTH, COUNT = 20, 4
#: Conversations of a block, and the most turns that one may take over from the block's first.
BLOCK, HEAD = 20, 4
#: Keys and bytes of keys of one run, roughly; beyond them there are more runs.
RUN_ROWS, RUN_BYTES = 100_000, 16 << 20
#: A shared node's children meet it under so many keys, so that none is hot.
SALTS = 32
OUT_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"


class Few:
    """A layout of up to 4 or 16 children: their bytes in order, and they beside them."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.kids = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid):
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = kid
        elif len(self.kids) == self.room:
            return moved(self, Few(16) if self.room == 4 else Some()).put(byte, kid)
        else:
            self.bytes.insert(at, byte)
            self.kids.insert(at, kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids, strict=True)


class Some:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("place", "kids")

    def __init__(self):
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int):
        return self.kids[self.place[byte] - 1] if self.place[byte] else None

    def put(self, byte: int, kid):
        if self.place[byte]:
            self.kids[self.place[byte] - 1] = kid
        elif len(self.kids) == 48:
            return moved(self, Full()).put(byte, kid)
        else:
            self.kids.append(kid)
            self.place[byte] = len(self.kids)
        return self

    def items(self):
        return [(b, self.kids[p - 1]) for b, p in enumerate(self.place) if p]


class Full:
    """A child for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def items(self):
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


def moved(old, new):
    for byte, kid in old.items():
        new = new.put(byte, kid)
    return new


class Node:
    """``label``: the bytes that lead here after the branch; ``ends``: the conversations whose key ends here."""

    __slots__ = ("label", "kids", "ends")

    def __init__(self, label: bytes):
        self.label, self.kids, self.ends = label, Few(), None


class Tree:
    """An adaptive radix tree of byte strings."""

    def __init__(self):
        self.root = None

    def at(self, key: bytes) -> Node:
        """The node where ``key`` ends, made if need be."""
        if self.root is None:
            self.root = Node(key)
            return self.root
        node, done, above, branch = self.root, 0, None, 0
        while True:
            label = node.label
            if not key.startswith(label, done):
                same = shared_prefix(key, done, label, 0)
                upper = Node(label[:same])
                upper.kids = upper.kids.put(label[same], node)
                node.label = label[same + 1:]
                if above is None:
                    self.root = upper
                else:
                    above.kids = above.kids.put(branch, upper)
                node = upper
                done += same
            else:
                done += len(label)
            if done == len(key):
                return node
            kid = node.kids.get(key[done])
            if kid is None:
                kid = Node(key[done + 1:])
                node.kids = node.kids.put(key[done], kid)
                return kid
            above, branch, node, done = node, key[done], kid, done + 1

    def add(self, key: bytes, conv: int) -> Node:
        node = self.at(key)
        if node.ends is None:
            node.ends = array("q")
        node.ends.append(conv)
        return node


class Visit:
    """A node on the way down: the depths it covers, whether it lies on the run's first or last key, and sums."""

    __slots__ = ("node", "above", "depth", "first", "last", "kids", "n", "least", "owned", "any", "leaves", "saved", "tops")

    def __init__(self, node, above, depth, first, last):
        self.node, self.above, self.depth, self.first, self.last = node, above, depth, first, last
        self.kids = list(node.kids.items())[::-1]
        self.n, self.least = (len(node.ends), min(node.ends)) if node.ends else (0, None)
        self.owned = self.leaves = self.saved = 0
        self.any, self.tops = False, []


def trie_nodes(tree: Tree, before: int, after: int):
    """One row of each trie node of a run: (depth, conv_id, n_convs, n_children, n_leaves, saved, ends, shared key,
    parent's conv_id, parent's shared key).

    ``before`` and ``after``: bytes that the run's first and last key have in common with the neighbouring run's
    (-1 without one). Nodes that another run has too carry a key, and figures that can be added up; a child's
    parent is named by its conversation, or by its key when it's a shared one.
    """
    path = bytearray(tree.root.label)
    stack = [Visit(tree.root, -1, len(path), True, True)]
    while stack:
        v = stack[-1]
        if v.kids:
            first = v.first and not v.node.ends and v.n == 0  # no key of this subtree came before
            byte, kid = v.kids.pop()
            del path[v.depth:]
            path.append(byte)
            path += kid.label
            # the child on the first key's path is the first one, the child on the last key's path the last one
            stack.append(Visit(kid, v.depth, len(path), first, v.last and not v.kids))
            continue
        stack.pop()
        del path[v.depth:]
        tops = v.tops
        low = v.depth - v.depth % WIDTH
        for depth in range(low, v.above if v.above < 0 else v.above - v.above % WIDTH, -WIDTH):
            left, right = v.first and depth <= before, v.last and depth <= after
            words = int.from_bytes(path[depth - COUNT:depth], "big") if depth else 0
            here = depth == v.depth
            v.saved += (v.n - (not left)) * words
            if not v.any:
                v.leaves = 0 if right else 1
            key = hashlib.blake2b(path[:depth], digest_size=16).digest() if left or right else None
            ends = v.node.ends if here and v.node.ends else ()
            row = [depth // WIDTH, v.least, v.n, v.owned, v.leaves, v.saved, ",".join(map(str, ends)), key, None, None]
            for child in tops:  # the nodes right below learn their parent
                child[8:] = (None, key) if key else (v.least, None)
                yield child
            tops, v.owned, v.any = [row], int(not left), True
        if stack:
            up = stack[-1]
            up.n += v.n
            up.least = v.least if up.least is None else min(up.least, v.least)
            up.owned += v.owned
            up.leaves += v.leaves
            up.saved += v.saved
            up.any |= v.any
            up.tops += tops
        else:
            yield from tops


NODE = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shared binary, parent_conv_id long, parent binary, run int"


def _build(borders: dict[int, tuple[int, int]]):
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]

    def emitted(tree, run):
        rows = []
        for row in trie_nodes(tree, *borders[run]):
            if row[7] is None:  # complete: the digest itself
                row[6] = hashlib.sha256(row[6].encode()).hexdigest()
            rows.append((*row, run))
            if len(rows) == OUT_ROWS:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        tree, now, last, node = None, None, None, None
        for batch in batches:
            for part, key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != now:
                    if tree is not None:
                        yield from emitted(tree, now)
                    tree, now, last = Tree(), part, None
                if key == last:
                    node.ends.append(conv)
                else:
                    node, last = tree.add(key, conv), key
        if tree is not None:
            yield from emitted(tree, now)

    return run


def _borders(batches):
    for batch in batches:
        run, first, last = (c.to_pylist() for c in batch.columns)
        same = [None if b is None else (lambda n: n - n % WIDTH)(shared_prefix(a, 0, b, 0)) for a, b in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(same, pa.int64())], ["run", "same"])


def _ends(batches):
    """(shared, digest) of rows sorted by node and run: one digest goes along the stream, whatever its length."""
    now = digest = None
    for batch in batches:
        out = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, empty = key, hashlib.sha256(), True
            if ends:
                digest.update(ends.encode() if empty else b"," + ends.encode())
                empty = False
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["shared", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["shared", "ends_sha256"])


def keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): the ids of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * (WIDTH - COUNT))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 2 * COUNT, "0")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, words).alias("id"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id")))["id"].alias("ids"))
    return listed.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation after the first turns of its block's first one in place of as many of its own."""
    start = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.substring("key", 1, HEAD * WIDTH).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD * WIDTH).cast("int")
    both = own.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("taken", taken).join(start, "block", "left")
    head = F.coalesce(F.col("head").substr(F.lit(1), F.col("taken")), F.lit(b""))
    return both.select("conv_id", F.concat(head, F.col("key").substr(F.col("taken") + 1, F.octet_length("key"))).alias("key"))


def prefix_trie(keyed: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, key), keys being whole ids of ``WIDTH`` bytes."""
    spark = keyed.sparkSession
    prepare(spark)
    keyed = stored(keyed, "keys")
    size = keyed.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // RUN_ROWS), -(-(size[1] or 0) // RUN_BYTES))
    dealt = stored(keyed.repartitionByRange(runs, "key", "conv_id").select(F.spark_partition_id().alias("run"), "key", "conv_id"), "runs")
    # one row a run, so a window over all of them is small
    ends = dealt.groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    border = ends.select("run", "first", F.lag("last").over(W.orderBy("run")).alias("last")).mapInArrow(_borders, "run int, same long").collect()
    same = [-1 if b.same is None else b.same for b in sorted(border, key=lambda b: b.run)]
    borders = {b.run: (same[k], same[k + 1] if k + 1 < len(same) else -1) for k, b in enumerate(sorted(border, key=lambda b: b.run))}
    sorted_runs = dealt.repartition(runs, "run").sortWithinPartitions("run", "key", "conv_id")
    nodes = stored(sorted_runs.mapInArrow(_build(borders), NODE), "nodes")
    split = nodes.where("shared is not null")
    chunks = split.select("shared", "ends", "run").repartition("shared").sortWithinPartitions("shared", "run").mapInArrow(_ends, "shared binary, ends_sha256 string")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = split.groupBy("shared").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
                                         *[F.sum(c).alias(c) for c in figures])
    merged = stored(merged.join(chunks, "shared"), "shared")
    final = ["conv_id", "depth", "parent_conv_id", *figures, "ends_sha256"]
    whole = nodes.where("shared is null").withColumnRenamed("ends", "ends_sha256")
    named = whole.where("parent is null").select(final)
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS))
    cut = ["conv_id", "depth", "parent", *figures, "ends_sha256"]
    below = whole.where("parent is not null").select(cut).union(merged.where("parent is not null").select(cut)).withColumn("salt", salt)
    above = merged.select(F.col("shared").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    top = merged.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(final)
    return named.union(below.join(above, ["parent", "salt"]).select(final)).union(top)


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    prepare(conversations.sparkSession)
    return prefix_trie(rebuilt(stored(keys(conversations), "own")))


#: DuckDB: prefixes as lists of ids, every node joined to all of its ancestors.
SQL = r"""
WITH t AS (SELECT list(v ORDER BY k) AS tbl FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(k))),
o AS (SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || '/' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
  ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ids FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ids, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM o, t),
r AS (SELECT a.conv_id, list_concat(coalesce(b.ids[1:a.h], []), a.ids[a.h + 1:]) AS ids FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT conv_id, unnest(range(0, len(ids) + 1)) AS depth, ids FROM r),
p AS (SELECT conv_id, depth, sha256(array_to_string(ids[1:depth], ',') || ':' || depth) AS k, CASE WHEN depth > 0 THEN sha256(array_to_string(ids[1:depth - 1], ',') || ':' || (depth - 1)) END AS up,
  CASE WHEN depth > 0 THEN split_part(ids[depth], '/', 2)::BIGINT ELSE 0 END AS words, len(ids) = depth AS last FROM m),
n AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY k),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT DISTINCT a.k AS above, b.k FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
g AS (SELECT s.above AS k, count(*) FILTER (c.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens FROM s JOIN n ON n.k = s.k LEFT JOIN c ON c.k = s.k GROUP BY s.above)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, g.n_leaves, g.saved_tokens, n.ends_sha256
FROM n JOIN g ON g.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n q ON q.k = n.up
"""
