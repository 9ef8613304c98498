"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, in built-in functions only.

A candidate is a run of a character class that is as long as the class's window, with digits or without. A
window slides over it; the counts of its characters, and the sum of c log2 c over them, change by one
character leaving and one entering, which gives the Shannon entropy at each place. The part between the
first and the last window at or above the class's threshold is a span, unless the allow list names the
candidate or what stands before it, or a fixed pattern's span holds it already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import where_found

#: Kinds in order, their patterns and the least length of the match (assign: of its value).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16)]

#: Class: name, characters (of the class, as in a pattern), alphabet, window, least entropy in bits a character.
CLASSES = [
    ("entropy_hex", "0-9a-fA-F", "0123456789abcdefABCDEF", 20, 3.0),
    ("entropy_base64", "A-Za-z0-9+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 3.9),
]
#: Allow list: candidates that are no secrets (the last line: joined words, plain or in camel case), and what stands before a digest that is meant to be public.
ALLOWED = (r"(?i)example|placeholder|dummy|changeme|0123456789|abcdefghij|x{6}|^[0-9]+$|^[A-Za-z]+([-_/+][A-Za-z]+)+[-_/]?[0-9]{1,4}$"
           r"|^(?-i:[A-Z]?[a-z]++(?:[-_/+][A-Z]?[a-z]++)++[-_/+]?|[A-Z]?[a-z]{2,}+(?:[A-Z][a-z]{2,}+)++)$"
           r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
PUBLIC_BEFORE = r"(?i)(sha-?(1|256|384|512)|md5|checksum|digest|integrity|etag|commit|revision|uuid)[\x20:=\"'_-]{0,4}$"
BEFORE = 24

ENTRY = "array<struct<start:int,no:int,end:int>>"


def candidate(chars: str, window: int) -> str:
    """Whole runs of the class that are long enough."""
    return f"(?<![{chars}])[{chars}]{{{window},}}+"


def hot_part(s: Column, alphabet: str, window: int, least: float) -> Column:
    """(lo, hi): from the first to the last window of at least ``least`` bits; lo is null if there is none."""
    f = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    place = lambda i: F.instr(F.lit(alphabet), F.substring(s, i, F.lit(1)))
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.array(
        F.struct(i.alias("i"), F.when(i > window, place(i - window)).otherwise(F.lit(0)).alias("p"), F.lit(-1).alias("d")),
        F.struct(i.alias("i"), place(i).alias("p"), F.lit(1).alias("d")))))
    begin = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(None).cast("int").alias("lo"), F.lit(0).alias("hi"))

    def step(st, e):
        c = F.element_at(st.counts, e.p)
        total = F.when(e.p > 0, st.total + f(c + e.d) - f(c)).otherwise(st.total)
        hot = (e.d > 0) & (e.i >= window) & (F.lit(math.log2(window)) - total / window >= least - 1e-9)
        return F.struct(
            F.when(e.p > 0, F.transform(st.counts, lambda x, j: F.when(j == e.p - 1, x + e.d).otherwise(x))).otherwise(st.counts).alias("counts"),
            total.alias("total"), F.when(hot & st.lo.isNull(), e.i - window).otherwise(st.lo).alias("lo"),
            F.when(hot, e.i).otherwise(st.hi).alias("hi"))

    return F.aggregate(steps, begin, step)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,inner:int>>")
    return F.when(text.rlike(pattern), where_found(text, F.lit(pattern), group)).otherwise(none)


def in_base(x: Column) -> Column:
    return F.exists("base", lambda b: (b.start <= x.start) & (b.end >= x.end))


def fixed(matches: Column, no: int, least: int) -> Column:
    """A fixed pattern's matches as spans, without those that are too short."""
    return F.transform(F.filter(matches, lambda m: m.inner >= least), lambda m: F.struct(m.start.alias("start"), F.lit(no).alias("no"), m.end.alias("end")))


def hot_spans(text: Column, candidates: Column, no: int, alphabet: str, window: int, least: float) -> Column:
    """The hot parts of the candidates that neither the allow list nor a base span holds."""
    def of(m):
        return F.substring(text, m.start + 1, m.end - m.start)

    def ahead(m):
        return F.substring(text, F.greatest(F.lit(1), m.start + 1 - BEFORE), F.least(m.start, F.lit(BEFORE)))

    fresh = F.filter(candidates, lambda m: ~in_base(m) & ~of(m).rlike(ALLOWED) & ~ahead(m).rlike(PUBLIC_BEFORE))
    hot = F.transform(fresh, lambda m: F.struct(m.start.alias("start"), hot_part(of(m), alphabet, window, least).alias("part")))
    return F.transform(F.filter(hot, lambda x: x.part.lo.isNotNull()), lambda x: F.struct(
        (x.start + x.part.lo).alias("start"), F.lit(no).alias("no"), (x.start + x.part.hi).alias("end")))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (struct of ``keep``), ``text`` (null: empty), ``base`` and ``spans``: sorted (start, no, end).

    ``no`` counts the kinds of BASE, then of CLASSES, from 0. Repeated rows each get their result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("text"))
    out = out.select("*", *[found(F.col("text"), p, g).alias(f"f{k}") for k, (_, p, g, _) in enumerate(BASE)],
                     *[found(F.col("text"), candidate(chars, w)).alias(f"c{k}") for k, (_, chars, _, w, _) in enumerate(CLASSES)])
    out = out.withColumn("base", F.array_sort(F.concat(*[fixed(F.col(f"f{k}"), k, n) for k, (*_, n) in enumerate(BASE)])))
    added = [hot_spans(F.col("text"), F.col(f"c{k}"), len(BASE) + k, *c[2:]) for k, c in enumerate(CLASSES)]
    fresh = F.filter(F.concat(*added), lambda x: ~in_base(x))
    return out.select("row", "text", "base", F.when(F.size(F.concat(*[F.col(f"c{k}") for k in range(len(CLASSES))])) > 0, F.array_sort(F.concat("base", F.array_distinct(fresh)))).otherwise(F.col("base")).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n, *_ in [*BASE, *CLASSES]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.no + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each stretch that spans cover replaced by ``mask``."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(spans, begin, lambda s, x: F.when(x.start >= s.at, F.struct(x.end.alias("at"), F.concat(
        s.out, F.array(F.substring(text, s.at + 1, x.start - s.at), F.lit(mask))).alias("out"))).otherwise(
        F.struct(F.greatest(s.at, x.end).alias("at"), s.out.alias("out"))))
    return F.when(F.size(spans) > 0, F.aggregate(F.array(walked), F.lit(""), lambda _, w: F.concat(
        F.array_join(w.out, ""), F.substring(text, w.at + 1, F.greatest(F.lit(0), F.length(text) - w.at))))).otherwise(text)


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x.no == k)).cast("long")
    return scan(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), *[n(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
