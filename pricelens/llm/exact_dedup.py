"""Exact duplicates by Patricia tries that own each text once.

1. Every task puts the normalised texts it reads into a compressed radix trie; a text that comes again reaches
   the terminal that is there. What leaves the task is each distinct text once, with the smallest id and the
   number of its rows ("share"), and for each document the number of its share. A text that a third of all rows
   hold leaves a task once for every ``TRIE_BYTES`` of other texts.
2. Shares are partitioned by the length and the SHA-256 of the text, and each partition inserts the full byte
   strings into a trie; the terminals hold the smallest id and the count. Texts with more than ``HOT`` shares
   pass one such round dealt by a salt beside length and digest first, so that no task reads all of them.
3. A trie that outgrows ``TRIE_BYTES`` gives up its largest subtree: what the subtree holds, and what would
   reach it later, goes out unsettled and is inserted in the next round, over more partitions. These rows
   lie in the shared folder, so nothing depends on an executor's disk.
4. Each document gets its owner through the number of its share, which few rows have in common.

Two texts are one only if all bytes agree; the digest deals texts out, but decides nothing. Null texts count
as empty, and all empty texts are equal. Null ids are never the smallest, unless a group has no other; rows
that repeat the smallest id stay with it. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_prefix, slices, stored, utf8

#: Bytes that a trie may hold before it gives up a subtree (in the first step: starts anew, as it does after so many rows).
TRIE_BYTES, TRIE_ROWS = 32 << 20, 50_000
#: Shares of a text beyond which they are combined by salt first.
HOT = 32
#: Bytes of distinct texts of one partition, roughly.
PART = 16 << 20
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


class Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.kids, self.value = label, None, value


class Trie:
    """A Patricia trie: each edge has a label of bytes, each node two children or a value at least.

    ``gone`` marks a branch whose subtree was given up.
    """

    gone = Node(b"")

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def terminal(self, key: bytes) -> Node | None:
        """The node of ``key``, made if need be; its value is None at first. None in a subtree that was given up."""
        node, at = self.root, 0
        while at < len(key):
            kids = node.kids
            kid = kids.get(key[at]) if kids else None
            if kid is Trie.gone:
                return None
            if kid is None:
                kid = Node(key[at:])
                self.size += len(key) - at
                if kids is None:
                    node.kids = {}
                node.kids[key[at]] = kid
                return kid
            if not key.startswith(kid.label, at):
                same = shared_prefix(key, at, kid.label, 0)
                upper = Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids = {kid.label[0]: kid}
                node.kids[key[at]] = upper
                kid = upper
            at += len(kid.label)
            node = kid
        return node

    def items(self, node: Node | None = None, prefix: bytes = b""):
        """(key, value) of every terminal below; one path of bytes is kept, whatever the depth."""
        path, stack = bytearray(prefix), [(node or self.root, len(prefix))]
        while stack:
            node, depth = stack.pop()
            del path[depth:]
            path += node.label
            if node.value is not None:
                yield bytes(path), node.value
            if node.kids:
                stack += [(kid, len(path)) for kid in node.kids.values() if kid is not Trie.gone]

    def give_up(self):
        """Cut off the subtree with the most bytes at the highest branch, and yield its (key, value) pairs.

        Nothing is cut off if all that is left is one path.
        """
        node, prefix = self.root, b""
        while True:
            kids = [k for k in (node.kids or {}).values() if k is not Trie.gone]
            if len(kids) != 1:
                break
            node, prefix = kids[0], prefix + kids[0].label
        if len(kids) < 2:
            return
        weights = [sum(len(n.label) for n in below(k)) for k in kids]
        kid = kids[weights.index(max(weights))]
        node.kids[kid.label[0]] = Trie.gone
        self.size -= max(weights)
        yield from self.items(kid, prefix)


def below(node: Node):
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [k for k in (node.kids or {}).values() if k is not Trie.gone]


def normalised(text: bytes | None) -> bytes:
    return SPACES.sub(b" ", text or b"")


LOCAL = "doc_id long, share long, digest binary, length long, text binary, least long, rows long"


def _local(limit: int):
    """Document rows with the number of their share, and a row for each share (only these have a ``length``)."""
    names = [f.split()[0] for f in LOCAL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def shares(trie):
        rows, size = [], 0
        for key, (share, digest, least, n) in trie.items():
            rows.append((None, share, digest, len(key), key, least, n))
            size += len(key)
            if size > 1 << 20 or len(rows) == 4096:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def run(batches):
        number, trie, seen = TaskContext.get().partitionId() << 33, Trie(), 0
        for batch in batches:
            for part in slices(batch, 1024, batch.column(1)):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), map(normalised, utf8(part.column(1))), strict=True):
                    if trie.size > limit or seen >= TRIE_ROWS:
                        yield from shares(trie)
                        trie, seen = Trie(), 0
                    node = trie.terminal(text)
                    if node.value is None:
                        node.value = [number, hashlib.sha256(text).digest(), doc, 0]
                        number += 1
                    value = node.value
                    value[3] += 1
                    if doc is not None and (value[2] is None or doc < value[2]):
                        value[2] = doc
                    out.append((doc, value[0], value[1], None, None, None, None))
                    seen += 1
                yield packed(out)
        yield from shares(trie)

    return run


MERGED = "length long, digest binary, text binary, least long, rows long, shares array<long>, settled boolean"


def _merge(limit: int, texts: bool):
    """Rows of ``MERGED`` in one trie: settled ones are complete for this task, the others were given up.

    Texts of settled rows go along only if asked for.
    """
    names = [f.split()[0] for f in MERGED.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
    def packed(pairs, settled):
        rows, size = [], 0
        for key, (digest, least, n, shares) in pairs:
            rows.append((len(key), digest, key if texts or not settled else None, least, n, shares, settled))
            size += len(key)
            if size > 1 << 20 or len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        trie = Trie()
        for batch in batches:
            for part in slices(batch, 1024, batch.column(1)):
                lost = []
                digests, least, n, shares = (part.column(k).to_pylist() for k in (0, 2, 3, 4))
                for k, key in enumerate(part.column(1).to_pylist()):
                    node = trie.terminal(key)
                    if node is None:
                        lost.append((key, (digests[k], least[k], n[k], shares[k])))
                        continue
                    if node.value is None:
                        node.value = [digests[k], least[k], n[k], shares[k]]
                        if trie.size > limit:
                            yield from packed(trie.give_up(), False)
                    else:
                        v = node.value
                        v[1] = min((x for x in (v[1], least[k]) if x is not None), default=None)
                        v[2] += n[k]
                        v[3] += shares[k]
                yield from packed(lost, False)
        yield from packed(trie.items(), True)

    return run


def merged(shares: DataFrame, *salt: str) -> DataFrame:
    """Equal texts of ``shares`` (of the same ``salt``) as one row each, by tries over partitions of length and digest."""
    spark, rounds = shares.sparkSession, []
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = shares
    while True:
        size = left.agg(F.sum("length")).first()[0]
        if size is None and rounds:
            break
        parts = max(floor, -(-(size or 0) // PART)) << min(len(rounds), 8)
        seed = F.lit(len(rounds))  # another round deals them otherwise
        dealt = left.repartition(parts, "length", "digest", seed, *salt)
        done = stored(dealt.select("digest", "text", "least", "rows", "shares").mapInArrow(_merge(TRIE_BYTES, bool(salt)), MERGED), "tries")
        rounds.append(done.where("settled").drop("settled"))
        left = done.where("not settled").drop("settled")
        if salt:  # a first round only: what was given up is settled by the next
            return rounds[0].union(left)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out


def owners(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, digest) for each row of ``docs``; ``digest``: SHA-256 of the normalised text."""
    prepare(docs.sparkSession)
    local = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_local(TRIE_BYTES), LOCAL)
    local = stored(local, "shares")
    columns = ["length", "digest", "text", "least", "rows", F.array("share").alias("shares")]
    shares = local.where("length is not null")
    hot = stored(shares.groupBy("length", "digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    shares = shares.select(*columns, "share")
    most = hot.agg(F.max("n")).first()[0]
    if most:
        salts = max(2, int(most**0.5))
        first = shares.join(hot.select("length", "digest"), ["length", "digest"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("share"), F.lit(salts)))
        shares = shares.join(hot.select("length", "digest"), ["length", "digest"], "left_anti").drop("share").union(
            merged(first.drop("share"), "salt").select("length", "digest", "text", "least", "rows", "shares"))
    else:
        shares = shares.drop("share")
    own = merged(shares).select(F.explode("shares").alias("share"), F.col("least").alias("keep_id"), F.col("rows").alias("group_size"))
    members = local.where("length is null").select("doc_id", "share", "digest")
    return members.join(own, "share").select(F.col("doc_id").alias("id"), "keep_id", "group_size", "digest")


def op13_exact_dedup(docs: DataFrame) -> DataFrame:
    return owners(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                               F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
