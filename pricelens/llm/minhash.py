"""Near-copy groups by b-bit MinHash, confirmed on full shingle sets.

1. Exact copies (equal word sequences) collapse into one class, kept under its smallest doc_id.
2. Each class gets 192 minima; rows of them make band keys (``BANDS``), and the low 4 bits of all are
   packed into twelve 64-bit words. Classes that share a band key form a bucket. Two sets with the
   threshold's similarity share no bucket with a chance of 3 in 10 million, less above it.
3. No bucket emits all its pairs. Its hub (the class that meets most others) is compared with each
   member: the bits are counted, corrected for chance agreement, and what may reach the threshold is
   confirmed on the full sets. Connected components of these links settle most buckets.
4. What is left are pairs of one bucket in different components. A bucket of at most ``SMALL`` members
   lists them. Larger ones that have members in common through their hubs are one family, in which every
   class is one row. Let C be any set of shingles (here those that most of a few members hold) and D(x)
   what x and C don't share. Then x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and are
   linked if that is at most k (|x| + |y|), k = (1 - t) / (1 + t). With f(x) = |D(x)| - k |x|:
   a. f(x) + f(y) <= 0 links x and y whatever they share, so whoever is linked to anybody this way is
      linked to the member of the least f. These links are a star.
   b. All others must have (f(x) + f(y)) / 2 or more of D in common. Only shingles that two components
      have count; members that can't reach it with these give nothing, the others meet at a prefix of
      their rarest ones, a pair at the first that it has in common.
   c. Where many meet at one shingle, they are a family of the next round, with a C of its own that holds
      this shingle: no more than half of the family before have it, so families shrink until they are
      small, or settled by their stars.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, slices, stored, utf8
from .features import Texts, U, mixed

#: Words of a shingle, and the threshold in hundredths that op9's contract fixes.
SHINGLE, THRESHOLD = 5, 85
MINIMA, BITS = 192, 4
WORDS = MINIMA * BITS // 64
#: Bands and rows by threshold: a pair at 0.85 shares none of 32 x 6 with a chance of 2.6e-7, one at 0.8 none of 38 x 5 with 2.8e-7.
BANDS = {85: (32, 6), 80: (38, 5)}
#: A bucket or family this small lists its pairs.
SMALL = 12
#: Members whose majority is a family's reference set (any set would do), and members that one task meets of a family at a time.
REFERENCE, MEET = 31, 500

_random = np.random.default_rng(20240229)
A = (_random.integers(0, 2**31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
B = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)
ODD = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) << U(1) | U(1)


def shingles(texts: list[bytes | None]) -> tuple[list[bytes | None], list[np.ndarray]]:
    """Of each text: a digest of its word sequence (None without words), and the sorted hashes of its distinct shingles."""
    t = Texts([(x or b"").lower() for x in texts])
    h = t.words()
    keys, sets = [], []
    for a, b in zip(t.first_word, t.last_word, strict=True):
        w = h[a:b]
        keys.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest() if b > a else None)
        if b - a >= SHINGLE:
            s = sum(w[k:len(w) - SHINGLE + 1 + k] * ODD[k] for k in range(SHINGLE))
        else:  # the whole sequence, told apart from longer ones by its length
            s = np.array([np.sum(w * ODD[:b - a], dtype=U) + U(b - a)], U)[:b - a]
        sets.append(np.unique(mixed(s)))
    return keys, sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``MINIMA`` 32-bit minima for each set; all sets have an element."""
    x = np.concatenate([(s >> U(32)).astype(np.uint32) for s in sets])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(x * a + b, at) for a, b in zip(A, B, strict=True)], 1)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.repeat(np.arange(1, bands + 1, dtype=U)[None, :], len(m), 0)
    for k in range(rows):
        out = mixed(out * U(0x9E3779B97F4A7C15) + m[:, k:bands * rows:rows].astype(U))
    return out.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, ``64 // BITS`` in a word."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(U).reshape(len(m), WORDS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=U) * U(BITS)), axis=2).view(np.int64)


def listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _sign(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 128, batch.column(1)):
                keys, sets = shingles(utf8(part.column(1)))
                has = [k for k, s in enumerate(sets) if len(s)]
                m = minima([sets[k] for k in has]) if has else np.zeros((0, MINIMA), np.uint32)
                at = np.full(len(sets), -1)
                at[has] = np.arange(len(has))
                index = pa.array(at, pa.int32(), mask=at < 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     listed(band_keys(m, bands, rows)).take(index), listed(packed(m)).take(index)], ["id", "key", "n", "bands", "bits"])

    return run


def _sets(batches):
    for batch in batches:
        for part in slices(batch, 128, batch.column(1)):
            _, sets = shingles(utf8(part.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "s"])


def similarity(x: str, y: str):
    """Estimate from two packed signatures: the share of equal low bits, corrected for chance agreement."""
    def differ(a, b):
        d = a.bitwiseXOR(b)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    unequal = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, d: s + d)
    chance = 2.0**-BITS
    return (1 - unequal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def margin(threshold: int) -> float:
    """Six standard deviations of the estimate at the threshold: one so far below it rules a pair out."""
    chance = 2.0**-BITS
    p = threshold / 100 * (1 - chance) + chance
    return 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def sizes_allow(m, n, threshold: int):
    return F.least(m, n) * 100 >= F.greatest(m, n) * threshold


def likely(pairs: DataFrame, classes: DataFrame, threshold: int, rows: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) that sizes and bits allow to reach the threshold, with ``n_a``, ``n_b``."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = stored(pairs.select("a", "b").distinct(), "pairs", rows).join(side("a"), "a").join(side("b"), "b")
    return both.where(sizes_allow(F.col("n_a"), F.col("n_b"), threshold)).where(similarity("bits_a", "bits_b") >= threshold / 100 - margin(threshold)).select("a", "b", "n_a", "n_b")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", F.size(F.array_intersect("s_a", "s_b")).cast("long"))


def links(o, m, n, threshold: int):
    return o * 100 >= (m + n - o) * threshold


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    return with_sets(pairs, sets).where(links(F.col("o"), F.col("n_a"), F.col("n_b"), threshold)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, by large-star and small-star rounds.

    Each round is written to the shared folder; a node's least neighbour is found by a map-side combined
    aggregate, so a hub with very many neighbours isn't gathered anywhere.
    """
    rows = 2 * edges.count()
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least", rows)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "edges", rows)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "edges", rows)


def hub_pairs(members: DataFrame) -> DataFrame:
    """(bucket, hub): the member that meets most others over all buckets; among equals, the smallest."""
    meets = members.groupBy("rep").agg(F.sum("size").alias("meets"))
    best = members.join(meets, "rep").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("rep")).alias("less"))).alias("best"))
    return best.select("bucket", (-F.col("best.less")).alias("hub"))


def attached(rows: DataFrame, info: DataFrame, parts: Column) -> DataFrame:
    """``rows`` (family, rep, ...) with the other columns of ``info`` (one row a family); a family is dealt to ``parts`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), parts))
    spread = info.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return salted.join(spread.drop(*[c for c in rows.columns if c != "family"]), ["family", "salt"]).drop("salt")


def several() -> Column:
    """Parts of a family whose size isn't at hand."""
    return F.lit(32).cast("long")


def by_size() -> Column:
    return F.floor(F.col("n") / MEET) + 1


def opened(rows: DataFrame) -> DataFrame:
    """The rows (family, rep, comp, ...) of families that aren't in one component yet, with the family's size ``n``."""
    sizes = rows.groupBy("family").agg(F.count("*").alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    return attached(rows, sizes.where("c != d").select("family", "n"), several())


def referred(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``rows`` (family, of, rep, from, comp, n) with ``d``, what a class and its family's reference set don't share, and ``f``.

    ``sets`` (of, rep, s, own, size): what of a class is compared (from place ``from`` on), how many of its shingles
    differ from everybody's in any case, and how many it has. With ``far`` the ones that aren't compared or not shared,
    and t hundredths, ``f`` is (100 + t) far - (100 - t) size; x and y are linked if f(x) + f(y) <= 2 (100 + t) |d(x) & d(y)|.
    A shingle that x lacks stands in ``d`` with its bits turned.
    """
    left = F.slice("s", F.col("from"), F.greatest(F.lit(0), F.size("s") - F.col("from") + 1))
    some = rows.withColumn("at", F.row_number().over(W.partitionBy("family").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("at") <= REFERENCE)
    held = some.join(sets, ["of", "rep"]).select("family", "n", F.explode(left).alias("token")).groupBy("family", "n", "token").agg(F.count("*").alias("by"))
    core = held.where(F.col("by") * 2 > F.least(F.col("n"), F.lit(REFERENCE))).groupBy("family").agg(F.collect_list("token").alias("core"))
    core = rows.select("family", "n").distinct().join(core, "family", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>")))
    both = attached(rows, stored(core, "cores"), by_size()).join(sets, ["of", "rep"]).withColumn("s", left)
    both = both.withColumn("d", F.concat(F.array_except("s", "core"), F.transform(F.array_except("core", "s"), F.bitwise_not)))
    both = both.withColumn("far", F.size("d") + F.col("own") + F.col("from") - 1)
    f = (100 + threshold) * F.col("far") - (100 - threshold) * F.col("size")
    return both.select("family", "rep", "comp", "n", "d", "far", "size", f.cast("long").alias("f"))


def stars(rows: DataFrame) -> DataFrame:
    """Links (a, b) of members to the one of the least ``f``, wherever the two sums alone link them."""
    lead = rows.groupBy("family", "n").agg(F.min(F.struct("f", "rep", "comp")).alias("lead"))
    linked = attached(rows, lead, by_size()).where((F.col("f") + F.col("lead.f") <= 0) & (F.col("comp") != F.col("lead.comp")))
    return linked.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()


def common(rows: DataFrame) -> DataFrame:
    """(family, rep, token, ...): of ``d`` what members of two components have, ``at`` its place from the rarest on, of ``have``."""
    token = rows.select("family", "rep", "comp", "f", "far", "size", F.explode("d").alias("token"))
    often = token.groupBy("family", "token").agg(F.count("*").alias("df"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    often = stored(often.where("c != d").select("family", "token", "df"), "tokens")  # the others link nothing new
    w = W.partitionBy("family", "rep")
    known = token.join(often, ["family", "token"]).withColumns({"at": F.row_number().over(w.orderBy("df", "token")), "have": F.count("*").over(w)})
    return known.withColumn("own", (F.col("far") - F.col("have")).cast("int")).drop("far")


def meetings(known: DataFrame, threshold: int) -> DataFrame:
    """(family, token, df, rep, comp, f, at, reach, low, high): the prefixes at which members must meet to be linked.

    Of a pair, the one of the smaller f looks through its ``low`` prefix, the other through its ``high`` one. A pair
    is looked for at the first shingle that it has in common, so what lies before counts for nothing there: nobody
    with an f beyond ``reach`` can be linked to this member from this shingle on.
    """
    one = 100 + threshold
    reach = lambda left: 2 * one * left - F.col("f")
    bounds = known.where("at = 1").groupBy("family").agg(F.max(reach(F.col("have"))).alias("most"), F.min("f").alias("least"))
    able = attached(known.withColumn("reach", reach(F.col("have") - F.col("at") + 1)), bounds, several()).where("f <= most and least <= reach")
    low = F.greatest(F.lit(1), F.ceil(F.col("f") / one))
    high = F.greatest(F.lit(1), F.ceil((F.col("f") + F.greatest(F.col("least"), 1 - F.col("f"))) / (2 * one)))
    able = able.withColumns({"low": F.col("at") <= F.col("have") - low + 1, "high": (F.col("f") > 0) & (F.col("at") <= F.col("have") - high + 1)})
    able = stored(able.where("low or high").select("family", "token", "df", "rep", "comp", "f", "at", "reach", "low", "high"), "able")
    # the same bounds once more among those who meet: the other side's least f and farthest reach
    side = lambda of, f, c: f(F.when(F.col(of), F.col(c)))
    ends = able.groupBy("family", "token").agg(side("low", F.min, "f").alias("lf"), side("low", F.max, "reach").alias("lr"),
                                               side("high", F.min, "f").alias("hf"), side("high", F.max, "reach").alias("hr"))
    able = able.join(ends.where("lr is not null and hr is not null"), ["family", "token"])
    able = able.withColumns({"low": F.expr("low and f <= hr and hf <= reach"), "high": F.expr("high and f <= lr and lf <= reach")})
    return able.where("low or high").drop("lf", "lr", "hf", "hr")


def met(at: DataFrame) -> DataFrame:
    """(family, token, pairs) where members of different components meet; of tokens at which the same members meet, the first in their order."""
    both = at.groupBy("family", "token", "df").agg(F.count("*").alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d"), F.count_if("low").alias("low"),
                                             F.count_if("high").alias("high"), F.sum(F.xxhash64("rep", "low", "high").cast("decimal(38,0)")).alias("mark"))
    both = both.where("c != d and n > 1").withColumn("pairs", F.col("low") * F.col("high")).where("pairs > 0")
    return both.groupBy("family", "n", "pairs", "mark").agg(F.min(F.struct("df", "token"))["token"].alias("token")).select("family", "token", "pairs")


def meeting_pairs(at: DataFrame) -> DataFrame:
    """The pairs (a, b) that meet, the low one's f first, and that have enough in common at best."""
    keys = ["family", "token"]
    both = at.where("low").alias("l").join(at.where("high").alias("r"), keys).where("l.f <= r.f and l.rep != r.rep and l.comp != r.comp")
    both = both.where("l.f + r.f > 0 and l.f <= r.reach and r.f <= l.reach")
    return both.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))


def listed_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of small buckets that lie in different components."""
    both = rows.alias("l").join(rows.alias("r"), "bucket").where("l.rep < r.rep and l.comp != r.comp")
    return both.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))


def placed_in(needed: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the links, and (rep, comp) for all of ``needed``."""
    root = components(links)
    root = root.union(root.select(F.col("root").alias("node"), "root").distinct())
    return root, stored(needed.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp")), "comps")


def family_links(rows: DataFrame, needed: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``links`` and those that the families ``rows`` (family, rep) lack to be settled.

    Families of a later round compare no more than what the members had in common with others before.
    """
    _, comps = placed_in(needed, links)
    rows = rows.select("family", F.lit(0).cast("long").alias("of"), "rep", F.lit(1).alias("from"))
    marks = sets.select(F.lit(0).cast("long").alias("of"), F.col("id").alias("rep"), "s", F.lit(0).alias("own"), F.size("s").alias("size"))
    while True:
        now = stored(opened(rows.join(comps, "rep")), "families")
        if not now.limit(1).count():
            return links
        now = stored(referred(now, marks, threshold), "referred")
        star = stored(stars(now), "stars")
        if star.limit(1).count():
            links = links.union(star)
            _, comps = placed_in(needed, links)
            now = opened(now.drop("comp", "n").join(comps, "rep"))
        known = stored(common(now), "common")
        at = stored(meetings(known, threshold), "meetings")
        places = stored(met(at), "places")
        few = meeting_pairs(at.join(places.where(F.col("pairs") <= SMALL * (SMALL - 1) // 2), ["family", "token"]))
        more = stored(confirmed(likely(few, classes, threshold), sets, threshold), "links")
        if more.limit(1).count():
            links = links.union(more)
            _, comps = placed_in(needed, links)
        many = at.join(places.where(F.col("pairs") > SMALL * (SMALL - 1) // 2), ["family", "token"])
        rows = stored(many.select(F.xxhash64("family", "token").alias("family"), F.col("family").alias("of"), "rep", F.col("at").alias("from")), "meet")
        wanted = rows.select("of", "rep").distinct()
        marks = known.withColumnRenamed("family", "of").join(wanted, ["of", "rep"], "left_semi").groupBy("of", "rep").agg(
            F.array_sort(F.collect_list(F.struct("at", "token")))["token"].alias("s"), F.first("own").alias("own"), F.first("size").alias("size"))
        marks = stored(marks, "marks")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``, linked at ``threshold`` hundredths (a key of ``BANDS``).

    Without words or text: no shingles, a component of its own. A row with a null id links with nothing and
    has a null component. Rows that repeat an id are one document (the text with the least digest stands for it).
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = stored(rows.mapInArrow(_sign(*BANDS[threshold]), "id long, key binary, n long, bands array<long>, bits array<long>"), "signed")
    named = signed.where("id is not null and key is not null")
    repeated = bool(signed.groupBy("id").agg(F.min("key").alias("k"), F.max("key").alias("m")).where("id is not null and k != m").limit(1).count())
    if repeated:  # only the text that stands for an id makes a class
        first = stored(named.groupBy("id").agg(F.min("key").alias("key")), "first")
        named = named.join(first, ["id", "key"])
    classes = stored(named.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(stored(shared, "shared"), "bucket"), "members")
    many_rows = members.count()
    needed = stored(members.select("rep").distinct(), "needed", many_rows)
    # The ids grow with the corpus: texts meet them by a sorted shuffle at every size, never by a broadcast.
    wanted = needed.select(F.col("rep").alias("id")).hint("merge")
    if repeated:
        keyed = rows.join(first, "id").mapInArrow(_keyed, "id long, key binary, own binary, s array<long>").where("key = own")
        sets = keyed.join(wanted, "id", "left_semi").dropDuplicates(["id"]).select("id", "s")
    else:
        sets = rows.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, s array<long>")
    sets = stored(sets, "sets")
    hubs = stored(hub_pairs(members), "hubs", many_rows)
    in_bucket = members.join(hubs, "bucket")
    star = in_bucket.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    found = stored(confirmed(likely(star, classes, threshold, many_rows), sets, threshold), "links", many_rows)
    _, comps = placed_in(needed, found)
    placed = stored(in_bucket.join(comps, "rep"), "placed", many_rows)
    open_buckets = stored(placed.groupBy("bucket").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c != d").select("bucket"), "open", many_rows)
    left = stored(placed.where("size > 2").join(open_buckets, "bucket", "left_semi"), "left", many_rows)
    few = listed_pairs(left.where((F.col("size") <= SMALL) & (F.col("rep") != F.col("hub"))).select("bucket", "rep", "comp"))
    found = found.union(stored(confirmed(likely(few, classes, threshold, many_rows), sets, threshold), "links"))
    around = stored(left.where((F.col("size") > SMALL) & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "around", many_rows)
    if around.limit(1).count():
        met_by = components(around)
        rows = stored(met_by.union(met_by.select("root", "root").distinct()).toDF("rep", "family").select("family", "rep"), "rows")
        found = family_links(rows, needed, found, classes, sets, threshold)
    root, _ = placed_in(needed, found)
    of_key = stored(classes.select("key", "rep").join(root.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("component")), "components")
    out = signed.select("id", "key", "n")
    if repeated:  # an id's rows share the component of the text that stands for it
        out = out.drop("key").join(first, "id", "left")
    out = out.join(of_key, "key", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _keyed(batches):
    for batch in batches:
        for part in slices(batch, 128, batch.column(1)):
            keys, sets = shingles(utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             ["id", "key", "own", "s"])


def op9_minhash(docs: DataFrame) -> DataFrame:
    out = near_copies(docs, threshold=THRESHOLD)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: DuckDB: shingle sets as strings, the similarity join through an inverted index, reachability by recursion.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
