"""Decontamination, quality rules, secrets, licenses and token counts against their plain definitions."""

import random

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm import decontaminate, licenses, quality, queries, secrets, stages, tokens, toxicity
from pricelens.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, spans int, n_words string, digest string"

ODD = ["", None, " ", "\n\n \t", "a", "É" * 3000, "x " * 40_000, "the cat sat\nthe cat sat\nthe cat sat\r\n", "one two three " * 30,
       "password=token=abcdefghijklmnop", "password=secret:abcdefghijklmnop", "é😀 API_KEY : \"aB3dE5fG7hI9jK1lM\" AKIAABCDEFGHIJ12345 é deadbeefdeadbeef0",
       "aws Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZjEyMzQ1Njc4OTBxd2VydHl1aW9w x", "sha256: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
       "id 123e4567-e89b-12d3-a456-426614174000", "AKIA" * 5, "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B",
       "aaaaaaaaaaaaaaaaaaaaaaaa1kT9xQ2vB7nM4pL8wZ3rY6sD0fGhJaaaaaaaaaaaaaaaaaaaaaaa", "secret=" + "q1" * 20_000,
       "É under, THE\n(MIT) licenseé under the mit license. Apache License, Version 2.0 apache license version 2 cc-by-nc CC BY NC 😀 cc by-nc 4.0",
       "SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: GPL-2.0-only\nCopyright (c) 2020 x. all rights reserved",
       "Permission is hereby granted, free of charge, to any person obtaining a copy", "under the mit licenses under the mit license" * 3, "the unlicense " * 300,
       "see LICENSE.txt for details, (C) ©2019", "<|endoftext|> a <|startoftext|>", "it's we'll 12 ½²ª", "a  b", "\x1c \x85", "Σας ΣΑΣ İI 中文"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the test tables and odd ones, with repeated rows, a null id and columns that clash with made ones."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10**9 + i, t) for i, t in enumerate(ODD)] + [(10**9 + 3, ODD[3]), (None, "under the mit license token = \"abcdefghijkl1\"")]
    return spark.createDataFrame([(i, t, "r", 1, "w", None) for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_decontamination(spark, docs, empty):
    bench = table(spark, SF, "benchmark")
    more = spark.createDataFrame([(9001, "the cat sat"), (9002, None), (None, "a"), (9003, " . "), (9004, "The CAT, sat!"), (10, "x x x x x x x x x x x")], "item_id long, text string")
    items = bench.union(more)
    named = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    got = sorted(map(tuple, decontaminate.op3_decontaminate(docs, items).collect()), key=str)
    assert got == sorted(((i, *brute.leaks(t, named)) for i, t in texts(docs)), key=str)
    blocks = decontaminate.scan(docs, items, ["doc_id"], block_bytes=120_000)  # several automata give the same
    again = blocks.select("row.doc_id", "n_words", decontaminate.covered(F.col("ranges")), F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), F.size("ranges") > 0)
    assert sorted(map(tuple, again.collect()), key=str) == got
    assert decontaminate.op3_decontaminate(empty, items).count() == 0
    assert not decontaminate.op3_decontaminate(docs, items.where("false")).where("contaminated").count()


def test_decontamination_spans_are_the_original_text(spark):
    d = spark.createDataFrame([(1, "É: Alpha—beta (GAMMA) delta")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha—BETA gamma")], "item_id long, text string")
    s = decontaminate.scan(d, b, ["doc_id"]).first().spans
    assert [("É: Alpha—beta (GAMMA) delta")[x.a:x.b] for x in s] == ["Alpha—beta (GAMMA"]


def test_quality_counts(spark, docs, empty):
    model = quality.train(docs, table(spark, SF, "labels"))
    out = quality.score(docs, model, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = sorted(((i, *brute.quality(t)) for i, t in texts(docs)), key=str)
    assert sorted((tuple(r)[:6] for r in out), key=str) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    none = quality.score(docs, quality.train(docs, table(spark, SF, "labels").where("false")), ["doc_id"])
    assert none.where("kept = base_failed").count() == 0


def split_labels(spark, sf="/root/testdata/sf0.01"):
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents"), labels.where("doc_id % 4 != 0"), labels.where("doc_id % 4 = 0")


def test_quality_held_out(spark):
    d, train, test = split_labels(spark)
    out = quality.score(d, quality.train(d, train), ["doc_id"]).select("row.doc_id", "quality", "base_failed", "kept").join(test, "doc_id").where("not base_failed").toPandas()
    good, bad = out[out.iloc[:, 4] == 1], out[out.iloc[:, 4] == 0]
    assert good["kept"].mean() >= 0.98 and bad["kept"].mean() <= 0.15


def test_toxicity_held_out(spark):
    """Three quarters of the labels at sf0.1, the last quarter held out."""
    d, train, test = split_labels(spark, "/root/testdata/sf0.1")
    out = toxicity.score(d.join(test, "doc_id", "left_semi"), toxicity.train(d, train), ["doc_id"]).select("row.doc_id", "p_insult", "p_contempt", "is_toxic").join(test.where("quality = 1"), "doc_id").toPandas()
    assert out[out.toxic == 1].is_toxic.mean() >= 0.95 and out[out.toxic == 0].is_toxic.mean() <= 0.02
    assert out[["p_insult", "p_contempt"]].to_numpy().min() >= 0


def test_toxicity_edges(spark, docs, empty):
    labels = table(spark, SF, "labels")
    links = toxicity.train(docs, labels)
    assert toxicity.score(docs, links, ["doc_id"]).count() == len(texts(docs)) and toxicity.score(empty, links, ["doc_id"]).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert not toxicity.score(docs, None, ["doc_id"]).where("is_toxic").count()


def test_secrets(spark, docs, empty):
    got = sorted(map(tuple, secrets.op1_secret_scan(docs).collect()), key=str)
    want = []
    for i, t in texts(docs):
        base, every = brute.spans(t)
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        want.append((i, *n, brute.hashlib.sha256(brute.joined(base).encode()).hexdigest(), brute.joined(every)))
    assert got == sorted(want, key=str)
    assert secrets.op1_secret_scan(empty).count() == 0


def test_secrets_of_letters_alone(spark):
    """Random letters are found without a digit among them; joined words, camel case and long words aren't."""
    rng = random.Random(5)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)) for _ in range(200)]
    prose = ["state-of-the-art-machine-learning-pipelines", "usr/local/share/documentation/packages", "getCustomerAccountBalanceForPeriod", "Donaudampfschifffahrtsgesellschaft",
             "gggggggggggggggggggggggggggggggggggg", "------------------------------------", "antidisestablishmentarianism"]
    d = spark.createDataFrame([(k, f"key {t} end") for k, t in enumerate([*keys, *prose])], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.op1_secret_scan(d).collect()}
    assert sum("entropy_base64:" in got[k] for k in range(200)) >= 195
    assert [prose[k - 200] for k in got if k >= 200 and got[k]] == []
    docs = table(spark, SF, "documents")
    letters = secrets.scan(docs, ["doc_id"]).select(F.explode(F.transform("spans", lambda x: F.substring(F.col("text"), x.start + 1, x.end - x.start))).alias("s"))
    assert letters.where("s rlike '^[A-Za-z/_+-]+$'").count() == 0


def test_token_counts_with_a_hot_text_and_a_stored_cache(spark, tmp_path):
    """A text that a third of the rows share is encoded once, and not at all when the cache has it."""
    rows = [(k, "one text that many rows share " * 50 if k % 3 == 0 else f"text {k}") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = tokens.cached(d, path, cache, ["doc_id"]).select("row.doc_id", "n_tokens").collect()
    assert spark.read.parquet(cache).count() == 2001
    again = tokens.cached(d.union(spark.createDataFrame([(5000, "a new text")], d.schema)), path, cache, ["doc_id"]).select("row.doc_id", "n_tokens").collect()
    assert spark.read.parquet(cache).count() == 2002
    want = {t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in (rows[0][1], rows[1][1])}
    assert {r.n_tokens for r in first if r.doc_id % 3 == 0} == {want[rows[0][1]]} and len(again) == 3001
    assert sorted(map(tuple, first)) == sorted(tuple(r) for r in again if r.doc_id != 5000)


def test_secrets_stage_masks_every_span(spark, docs):
    out = stages.secrets(spark, docs.withColumn("n_chars", F.length("text")), SF)
    assert out.columns == [*docs.columns, "n_chars"]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted(((i, t and brute.masked(t), None if t is None else len(brute.masked(t))) for i, t in texts(docs)), key=str)


def test_entropy_of_each_window(spark):
    """The incremental sums against whole recounts, on random strings."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdef0123456789"[:rng.randint(2, 16)]) for _ in range(rng.randint(20, 60)))) for i in range(60)]
    d = spark.createDataFrame(rows, "i int, s string")
    name, _, alphabet, size, least = secrets.CLASSES[0]
    got = {r.i: (r.p.lo, r.p.hi) for r in d.select("i", secrets.hot_part(F.col("s"), alphabet, size, least).alias("p")).collect()}
    for i, s in rows:
        hot = [k for k in range(len(s) - size + 1) if brute.entropy(s[k:k + size]) >= least - 1e-9]
        assert got[i] == ((hot[0], hot[-1] + size) if hot else (None, 0))


def test_licenses(spark, docs, empty):
    got = sorted(map(tuple, licenses.op6_license_scan(docs).collect()), key=str)
    assert got == sorted(((i, *brute.license_row(t)) for i, t in texts(docs)), key=str)
    assert licenses.op6_license_scan(empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    rng = random.Random(3)
    t = Tokenizer.from_file(public_tokenizers.path(name))
    ids = tokens.encode(public_tokenizers.path(name))
    some = [x or "" for x in ODD if len(x or "") < 5000]
    some += ["".join(rng.choice(" \n'sadÉé1.½ª!\t<|>xY¿") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for x in some:
        assert np.frombuffer(ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_token_cache(spark, docs, empty, tmp_path):
    cache, path = f"file://{tmp_path}/cache", public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts(docs)), key=str)

    def run(d):
        return sorted(((r.row.doc_id, r.n_bytes, r.n_tokens) for r in tokens.cached(d, path, cache, ["doc_id"]).collect()), key=str)

    assert run(docs.where("doc_id < 100")) == [w for w in want if w[0] is not None and w[0] < 100]
    before = spark.read.parquet(cache).count()
    assert run(docs) == want
    distinct = len({x or "" for _, x in texts(docs)})
    assert before < spark.read.parquet(cache).count() == distinct  # only what was missing came to it
    assert run(docs) == want and spark.read.parquet(cache).count() == distinct
    spark.read.parquet(cache).write.mode("append").parquet(cache)  # two writers at once
    assert run(docs) == want and run(empty) == []
    stored = spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("long")).limit(0)
    assert stored.count() == 0


@pytest.mark.parametrize("name", ["op3_decontaminate", "op8_warc", "op9_minhash"])
def test_queries_equal_sql(spark, name):
    from pricelens.plans.check import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()) is None
