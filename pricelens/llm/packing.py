"""Best-fit packing by linear grouping.

Every document becomes token ids and a final 0; only documents of more than ``CAPACITY`` tokens are cut.
Packing needs lengths alone, and there are at most ``CAPACITY`` distinct ones: the driver sees a
histogram of at most 2048 rows, whatever the corpus holds, and returns segments (length, ranks, first
sequence, offset). Ranks within a length come from a salted, deterministic two-level count, so that a
length shared by a third of all pieces isn't one group, and a re-run task finds the same ranks.

Scheme: large lengths are dealt into groups of equal cardinality and rounded up to their group's
largest (no more distinct lengths than groups: each is its own); configurations of these few sizes are
optimised by column generation over a knapsack; actual pieces then take the configurations' places, the
last one of each the longest that the actual ones before it leave room for. What
rounding the counts down leaves over, and the small pieces, go best-fit into the room left.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, stored, utf8
from .tokens import encode

CAPACITY = 2048
#: Lengths above this are large; groups of large lengths; rounds of column generation; pieces in one salt group of a length.
LARGE, GROUPS, ROUNDS, SALTED = 256, 64, 256, 2_000


def pieces(docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``row``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``n_tokens`` of the document), one row a piece.

    Null texts are empty; an empty text has the final 0 alone.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")])

    def run(batches):
        ids_of = encode(path)
        for batch in batches:
            for part in slices(batch, 256, batch.column(1)):
                take, made = [], []
                for k, b in enumerate(utf8(part.column(1))):
                    ids = ids_of((b or b"").decode()) + b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        take.append(k)
                        made.append((p, at // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*made, strict=True)) if made else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int32())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                    ["row", "piece", "start", "length", "ids_crc32"])

    return packed.mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    order = np.argsort(sizes)
    size, worth = sizes[order], value[order]
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")  # sizes that fit
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(size[0]), capacity + 1):
        v = best[c - size[:upto[c]]] + worth[:upto[c]]
        k = v.argmax()
        if v[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes and how often each is used, in whole numbers, within the demand.

    Column generation: the dual prices of a basis ask the knapsack for a better configuration until there is none.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, column = knapsack(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = column
    left, found = demand.copy(), []
    for k in np.argsort(-x):
        column = basis[:, k].astype(int)
        n = min([int(x[k] + 1e-6), *(left[column > 0] // column[column > 0])])
        if n > 0:
            found.append((column, n))
            left = left - column * n
    return found


def grouped(big: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, pieces), the largest first, dealt into groups of equal cardinality; in a group, the largest comes last."""
    share = -(-sum(n for _, n in big) // groups)
    if len(big) <= groups:
        return [[b] for b in big]
    by_top: dict[int, list[tuple[int, int]]] = {}
    got, top = 0, None
    for x, n in big:
        while n:
            if got % share == 0:
                top = x
            now = min(n, share - got % share)
            by_top.setdefault(top, []).append((x, now))
            n, got = n - now, got + now
    return [g[::-1] for g in by_top.values()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): rank first + k of that length goes to sequence first + k.

    Its size depends on the distinct lengths, of which there are ``capacity`` at most, not on the number of pieces.
    """
    taken = dict.fromkeys(histogram, 0)
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    levels: list[int] = []  # sorted rooms that have sequences
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, taken[length], n, first, offset))
        taken[length] += n

    def free(left: int, first: int, n: int) -> None:
        if left:
            if left not in room:
                bisect.insort(levels, left)
                room[left] = []
            room[left].append((first, n))

    rest = {x: n for x, n in histogram.items() if n}
    if rest.get(capacity):
        put(capacity, rest[capacity], sequences, 0)
        sequences += rest.pop(capacity)
    big = sorted((x for x in rest if x > large), reverse=True)
    if big:
        pools = grouped([(x, rest.pop(x)) for x in big], groups)
        sizes = np.array([p[-1][0] for p in pools])  # the largest is at the end, and taken first
        there: dict[int, int] = {}
        for x, n in (y for p in pools for y in p):
            there[x] = there.get(x, 0) + n
        lengths = sorted(there)

        def take(x: int, n: int) -> int:
            now = min(n, there[x])
            there[x] -= now
            if not there[x]:
                lengths.remove(x)
            return now

        for column, times in configurations(sizes, np.array([sum(n for _, n in p) for p in pools]), capacity):
            slots = np.repeat(np.arange(len(column)), column)
            spans = [(sequences, times, 0)]  # first, number, filled
            for j, k in enumerate(slots):
                after = []
                for first, n, filled in spans:
                    while n:
                        # in the last place, the longest piece that the actual ones before it leave room for
                        upto = capacity - filled if j == len(slots) - 1 else int(sizes[k])
                        at = bisect.bisect_right(lengths, upto) - 1
                        if at < 0:
                            after.append((first, n, filled))
                            break
                        x = lengths[at]
                        now = take(x, n)
                        put(x, now, first, filled)
                        after.append((first, now, filled + x))
                        first, n = first + now, n - now
                spans = after
            empty = min((first for first, _, filled in spans if not filled), default=sequences + times)
            for first, n, filled in spans:
                if filled:
                    free(capacity - filled, first, n)
            sequences = empty if all(first < empty for first, _, filled in spans if filled) else sequences + times
        rest |= {x: n for x, n in there.items() if n}
    for x in sorted(rest, reverse=True):
        n = rest[x]
        while n:
            k = bisect.bisect_left(levels, x)
            if k == len(levels):
                new = max(1, n // (capacity // x))
                free(capacity, sequences, new)
                sequences += new
                continue
            left = levels[k]
            first, there = room[left].pop()
            if not room[left]:
                del room[left], levels[k]
            now = min(n, there)
            if there > now:
                free(left, first + now, there - now)
            put(x, now, first, capacity - left)
            free(left - x, first, now)
            n -= now
    return np.array(out, np.int64).reshape(-1, 5)


def ranked(made: DataFrame, histogram: dict[int, int], order: list[str], salted: int = SALTED) -> DataFrame:
    """``rank`` of each row within its ``length``, from 0: rows of a salt group are counted, then numbered.

    A length has a salt for every ``salted`` of its own rows, so groups are few and none is long; the table of
    salts has a row for each length, of which there are as many as the capacity at most.
    """
    salts = made.sparkSession.createDataFrame([(x, 1 + n // salted) for x, n in histogram.items()], "length long, __salts long")
    own = made.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), "__salts")).drop("__salts")
    sizes = own.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.select("length", "__salt", (F.sum("__n").over(W.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    numbered = own.withColumn("__k", F.row_number().over(W.partitionBy("length", "__salt").orderBy(*order)))
    return numbered.join(before, ["length", "__salt"]).withColumn("rank", F.col("__before") + F.col("__k") - 1).drop("__salt", "__before", "__k")


def pack(made: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for each row of ``made``, a stored table with ``length`` (1 to ``capacity``)."""
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect()}
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = rows[:, 0] << 44 | rows[:, 1]  # sorted by length, then by first rank
    numbered = ranked(made, histogram, order)
    schema = T.StructType([*numbered.schema, *T.StructType.fromDDL("sequence_id long, offset long")])

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows[k, 3] + rank - rows[k, 1]), pa.array(rows[k, 4])], schema.names)

    return numbered.mapInArrow(run, schema).drop("rank")


def pack_documents(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """Columns ``keep``, then piece, start, length, ids_crc32, sequence_id and offset."""
    made = stored(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), keep, text), "pieces")
    out = pack(made, ["row", "piece"])
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, ["doc_id"])
