"""License scans: ordered signature rules gated by keywords, in built-in functions only.

A text without any rule's keyword isn't searched. Another one is lower-cased (A-Z), and a rule's pattern is tried where the text holds the rule's own keyword. Detections that lie inside another one of the same or a higher priority
go, and a general notice goes where a named license overlaps it. Fixed phrases are found beside that,
by their words, and always stay.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LICENSES, TAG, gate_words, identifier, rules
from .positions import where_found

#: Phrases and labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: A character of a word (digits, letters, all that isn't ASCII), and one that isn't.
IN, OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Score of the strongest detection, by priority.
SCORES = {0: 0.95, 1: 0.3, 2: 0.8, 3: 1.0}

FOUND = "array<struct<start:int,end:int,priority:int,label:string>>"


def phrase_pattern(phrase: str) -> str:
    first = f"(?=[{phrase[0]}{phrase[0].upper()}])"  # the cheapest test, at each place
    return f"{first}(?<!{IN})" + f"{OUT}+".join(f"(?i:{w})" for w in phrase.split()) + f"(?!{IN})"


def any_word(words: list[str]) -> str:
    """One pattern for all words, as a tree of common beginnings."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at.clear()  # what is longer holds this word
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [re.escape(c) + pattern(rest) for c, rest in sorted(at.items()) if c]
        return "" if "" in at or not parts else parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


def n_words(text: Column) -> Column:
    """Parts between gaps, without the empty ones that a gap at either end leaves. (Counting the words' own
    pattern gives the same ten times slower.)"""
    parts = F.split(text, F.lit(f"{OUT}+"), -1)
    blank = lambda w: F.when(w == "", 1).otherwise(0)
    return F.greatest(F.lit(0), F.size(parts) - blank(F.element_at(parts, 1)) - blank(F.element_at(parts, -1))).cast("long")


def word_starts(text: Column, phrase: str) -> Column:
    """Number of the first word of each occurrence, from 0: words of the pieces before it, and of earlier occurrences."""
    pattern, k = phrase_pattern(phrase), len(phrase.split())
    pieces = F.split(text, F.lit(pattern), -1)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    walked = F.aggregate(pieces, begin, lambda s, p: F.struct((s.at + n_words(p) + k).alias("at"), F.concat(s.out, F.array(s.at + n_words(p))).alias("out"))).out
    return F.when(text.rlike(pattern), F.slice(walked, 1, F.size(walked) - 1)).otherwise(F.array().cast("array<bigint>"))


def detections(low: Column) -> Column:
    """(start, end, priority, label) of every rule's matches, by start, longer and stronger first."""
    def listed(some: list[tuple]) -> Column:
        return F.from_json(F.lit(json.dumps([dict(zip(("label", "priority", "word", "pattern"), r, strict=True)) for r in some])),
                           "array<struct<label:string,priority:int,word:string,pattern:string>>")

    def matches(text: Column, some: Column, at: Column) -> Column:
        used = F.filter(some, lambda r: F.contains(text, r.word))
        used = F.filter(used, lambda r: F.regexp_like(text, r.pattern))
        return F.flatten(F.transform(used, lambda r: F.transform(where_found(text, r.pattern), lambda m: F.struct(
            (at + m.start).alias("start"), (-at - m.end).alias("to"), (-r.priority).alias("rank"), r.label.alias("label")))))

    ids = listed([(label, 3, "", identifier(spdx)) for label, spdx, *_ in LICENSES])
    lines = F.when(F.contains(low, F.lit(TAG)), where_found(low, F.lit(f"{TAG}:[^\\n]*"))).otherwise(F.array().cast("array<struct<start:int,end:int,inner:int>>"))
    tagged = F.transform(lines, lambda x: matches(F.substring(low, x.start + len(TAG) + 2, x.end - x.start - len(TAG) - 1), ids, x.start + len(TAG) + 1))
    each = F.concat(F.flatten(tagged), matches(low, listed([r for r in rules() if r[2] != TAG]), F.lit(0)))
    return F.transform(F.array_sort(each), lambda d: F.struct(d.start.alias("start"), (-d.to).alias("end"), (-d.rank).alias("priority"), d.label.alias("label")))


def outermost(found: Column) -> Column:
    """In order of start: those that end beyond all before them."""
    begin = F.struct(F.lit(-1).alias("to"), F.array().cast(FOUND).alias("out"))
    return F.aggregate(found, begin, lambda s, d: F.when(d.end > s.to, F.struct(d.end.alias("to"), F.concat(s.out, F.array(d)).alias("out"))).otherwise(s)).out


def resolved(found: Column) -> Column:
    """Priorities from high to low: inside a kept one, nothing of its priority or below stays; general notices may not touch a named one."""
    exact = outermost(F.filter(found, lambda d: d.priority == 3))
    names = F.filter(outermost(F.filter(found, lambda d: d.priority == 2)), lambda d: ~F.exists(exact, lambda k: (k.start <= d.start) & (k.end >= d.end)))
    named = F.concat(exact, names)
    general = F.filter(outermost(F.filter(found, lambda d: d.priority == 1)), lambda d: ~F.exists(named, lambda k: (k.start < d.end) & (k.end > d.start)))
    return F.concat(named, general)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row``, ``n_words``, ``starts`` (an array for each phrase) and ``found`` (resolved detections, code points).

    A null or empty text has no words and no detections; repeated rows each get their result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("text"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    begin, inside = (any_word(sorted(ws, key=lambda w: (len(w), w))) for ws in gate_words())
    gate = f"(?i:(?<![A-Za-z]){begin}|{inside})"
    out = out.select("row", n_words(F.col("text")).alias("n_words"), F.array(*[word_starts(F.col("text"), p) for p, _ in PHRASES]).alias("starts"),
                     F.when(F.col("text").rlike(gate), F.translate("text", upper, lower)).alias("low"))
    out = out.withColumn("found", F.when(F.col("low").isNotNull(), detections(F.col("low"))).otherwise(F.array().cast(FOUND)))
    return out.select("row", "n_words", "starts", F.when(F.size("found") > 0, resolved(F.col("found"))).otherwise(F.col("found")).alias("found"))


def op6_license_scan(docs: DataFrame) -> DataFrame:
    labels = F.array_sort(F.flatten(F.array(*[
        F.when(F.size(F.col("starts")[k]) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(PHRASES)])))
    all_labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("found", lambda d: d.label))))
    value = lambda p: F.when(p == 3, SCORES[3]).when(p == 2, SCORES[2]).otherwise(SCORES[1])
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: value(d.priority))), F.lit(0.0)), F.when(F.size("all") > 0, SCORES[0]).otherwise(0.0))
    out = scan(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", F.flatten("starts").alias("all"), labels.alias("base"), "found")
    return out.select("doc_id", "n_words", F.size("all").cast("long").alias("n_base"), F.array_min("all").alias("first_word"), F.array_max("all").alias("last_word"),
                      F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), best.alias("score"))
