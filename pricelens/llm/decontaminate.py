"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII
characters. Every run of ``WINDOW`` words of an item (the whole item, if it is shorter) is a pattern of
the automaton; each document is scanned once, in normalised form, and hits map back to its own words.

The patterns are a stated query set held in blocks by a hash of the pattern: a block has about ``block_bytes``
of patterns (an automaton takes some 35 times that), so what one task holds is bounded however many items there
are and however long one is. A worker process builds a block's automaton once. One block is one pass over the
documents without a shuffle; further blocks are further passes over a stored table.
"""

from __future__ import annotations

import uuid
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, flat, prepare, stored, utf8

WINDOW = 10
BLOCK_BYTES = 8_000_000

#: A-Z to a-z; what is no word character becomes a space. On UTF-8 bytes, all of a non-ASCII character's bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_built: dict[str, ahocorasick.Automaton | None] = {}  # of this worker process: the newest block's automaton


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows(ws: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not ws:
        return []
    return [tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))]


def patterns(items: DataFrame, size: int) -> DataFrame:
    """``id`` and ``pattern`` (a window's words between single spaces, in UTF-8) of each window of the items ``id`` and ``t``."""
    prepare(items.sparkSession)

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                made = windows(words(text), size)
                for at in range(0, len(made), 10_000):
                    own = [b" ".join(w) for w in made[at:at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary())], ["id", "pattern"])

    return items.mapInArrow(run, "id string, pattern binary").distinct()


def automaton(block: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton | None:
    """Value of a pattern: its number of words and the items that have it. None if there is no pattern."""
    if not block:
        return None
    found = ahocorasick.Automaton()
    for pattern, ids in block:
        found.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, tuple(ids)))
    found.make_automaton()
    return found


def normal(text: bytes) -> np.ndarray:
    """The words of a text with one space before, between and after them, as bytes; without words, one space."""
    x = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8)
    gap = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return x[keep]


def hits(found: ahocorasick.Automaton | None, line: np.ndarray) -> tuple[np.ndarray, set]:
    """Merged word ranges [from, to) inside any occurrence, as rows, and the items found."""
    ends, sizes, ids = array("q"), array("q"), set()
    if found is not None and len(line) > 1:
        for end, (n, own) in found.iter(line.tobytes().decode("latin-1")):
            ends.append(end)
            sizes.append(n)
            ids.update(own)
    if not ends:
        return np.zeros((0, 2), np.int64), ids
    to = np.searchsorted(np.flatnonzero(line == 32), np.frombuffer(ends, np.int64))  # words before the space where it ends
    return merged(to - np.frombuffer(sizes, np.int64), to), ids


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranges [a, b) as rows, those that meet or overlap as one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[new], b[np.concatenate([new[1:], [True]])]], axis=1)


def original(text: bytes, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges as ranges of code points of the original text."""
    if not len(ranges):
        return []
    gap = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8) == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1])  # bytes where words begin and end, by turns
    cuts = np.stack([edge[2 * ranges[:, 0]], edge[2 * ranges[:, 1] - 1]], axis=1).ravel()
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # first bytes of code points
    upto = np.cumsum([np.count_nonzero(first[i:j]) for i, j in zip([0, *cuts[:-1]], cuts)])
    return [(int(i), int(j)) for i, j in upto.reshape(-1, 2)]


def _scan(block: list):
    key = uuid.uuid4().hex

    def make():
        if key not in _built:
            _built.clear()
            _built[key] = automaton(block)
        found = _built[key]

        def fn(texts):
            out = []
            for text in texts:
                line = normal(text or b"")
                ranges, ids = hits(found, line)
                out.append((int(np.count_nonzero(line == 32)) - 1, [{"a": a, "b": b} for a, b in ranges.tolist()], sorted(ids),
                            [{"a": a, "b": b} for a, b in original(text or b"", ranges)]))
            return list(zip(*out, strict=True)) if out else [[], [], [], []]

        return fn

    return make


def scan(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (struct of ``keep``), ``n_words``, ``ranges`` (word numbers a to b, b exclusive), ``items``
    (sorted strings) and ``spans`` (the same as code points of the original text), one row for each row of ``docs``.

    Null or empty texts have no words; items without words, or with a null id or text, find nothing; equal
    items are all reported; repeated rows each get their result; an empty benchmark finds nothing.
    """
    items = bench.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("string").alias("t")).where("id is not null and t is not null")
    found = stored(patterns(items, size).groupBy("pattern").agg(F.collect_set("id").alias("ids")), "patterns")
    n = found.agg(F.sum(F.octet_length("pattern") + F.lit(2))).first()[0] or 0
    blocks = max(1, -(-n // block_bytes))
    added = "n_words long, ranges array<struct<a:long,b:long>>, items array<string>, spans array<struct<a:long,b:long>>"
    out = None
    for k in range(blocks):
        mine = [(bytes(r.pattern), sorted(r.ids)) for r in found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).toLocalIterator()]
        if out is None:
            base = list(dict.fromkeys([*keep, text])) if blocks > 1 else keep
            out = annotate(docs, base, text, _scan(mine), added)
            continue
        before = stored(out, "decontaminate")
        more = before.select(*[F.col("row")[c].alias(c) for c in base], F.struct("ranges", "items", "spans").alias("__before"))
        out = annotate(more, [*base, "__before"], text, _scan(mine), added).select(
            F.struct(*[F.col("row")[c].alias(c) for c in base]).alias("row"), "n_words",
            F.concat("row.__before.ranges", "ranges").alias("ranges"),
            F.array_sort(F.array_distinct(F.concat("row.__before.items", "items"))).alias("items"),
            F.concat("row.__before.spans", "spans").alias("spans"))
    if blocks > 1:
        out = out.select(F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), "n_words", "ranges", "items", "spans")
    return out


def covered(ranges):
    """Words (or code points) inside any of the ranges, which later blocks may have let overlap."""
    total = F.aggregate(F.array_sort(ranges), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                        lambda s, r: F.struct((s.n + F.greatest(F.lit(0).cast("long"), r.b - F.greatest(r.a, s.to))).alias("n"),
                                              F.greatest(s.to, r.b).alias("to")))
    return F.when(F.size(ranges) > 0, total.n).otherwise(F.lit(0).cast("long"))


def op3_decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's digest of :func:`scan`."""
    found = scan(docs, bench, ["doc_id"])
    out = flat(found, ["doc_id"], [
        "n_words", covered(F.col("ranges")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256")])
    return out.withColumn("contaminated", F.col("n_hit") > 0)


#: DuckDB: words by regexp, windows as space-framed strings, occurrences by word position.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM
      (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.i, g.k, p.item_id FROM g JOIN p ON g.g = p.g AND g.k = p.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.l, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
