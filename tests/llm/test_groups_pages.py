"""Near copies, packing, web archives, HTML extraction and the pipeline against plain definitions."""

import bisect
import collections
import gzip
import io
import os
import random
import re
import subprocess
import sys
import zlib
from html import unescape

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm import main_text, minhash, packing, stages, warc
from pricelens.llm.common import scratch, table
from pricelens.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"


def edited(rng, words, share, at=None):
    """Words with a share of them replaced, alone or in one stretch."""
    out, n = list(words), max(1, round(share * len(words)))
    for k in range(at, min(at + n, len(out))) if at is not None else rng.sample(range(len(out)), n):
        out[k] = f"w{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def groups():
    """Families of copies with edits around the threshold, chains, cut and grown copies, short and empty texts."""
    rng, rows = random.Random(12), []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 160))]
        rows.append(base)
        for _ in range(45):
            kind = rng.random()
            if kind < 0.4:
                rows.append(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])))
            elif kind < 0.7:  # one changed stretch: similarity from 0.75 to 0.95
                rows.append(edited(rng, base, rng.uniform(0.02, 0.14), rng.randrange(len(base))))
            elif kind < 0.85:
                rows.append(base[:rng.randint(int(0.7 * len(base)), len(base))])
            else:
                rows.append(base + [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(1, 25))])
        for _ in range(6):  # chains of copies of copies
            rows.append(edited(rng, rows[-1], 0.04, rng.randrange(len(rows[-1]))))
    shared = [f"s{k}" for k in range(40)]
    rows += [shared + [f"u{rng.randrange(10**9)}" for _ in range(30)] for _ in range(40)]  # one passage, else different
    texts = [" ".join(w) for w in rows]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), texts[3], texts[3]]
    texts += ["", None, "  \n", "a b c", "A b  c", "a b c d", "a b c d e", "a a a a a a", "a a a a a", "É b c", "é b c"]
    rng.shuffle(texts)
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


def test_near_copies(spark, groups, monkeypatch):
    want = sorted((i, *v) for i, v in brute.near(groups).items())
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in groups], "doc_id long, text string, key int, n string")
    for small in (minhash.SMALL, 2):  # with 2, all but pairs and triples go beyond the hub
        monkeypatch.setattr(minhash, "SMALL", small)
        got = sorted(map(tuple, minhash.near_copies(d).collect()))
        assert got == want
    assert len({c for *_, c in want}) < 0.8 * len(want)


def test_near_copies_edges(spark, groups):
    d = spark.createDataFrame(groups[:40], "doc_id long, text string")
    assert minhash.near_copies(d.where("false")).count() == 0
    assert minhash.near_copies(d.where("text is null or trim(text) = ''")).where("id != component_id").count() == 0
    odd = d.union(d).union(spark.createDataFrame([(None, groups[0][1])], d.schema)).union(spark.createDataFrame([(groups[5][0], "other words of the same document")], d.schema))
    got = minhash.near_copies(odd).collect()
    assert len(got) == 82 and [r.component_id for r in got if r.id is None] == [None]
    want = brute.near(groups[:40])
    assert {(r.id, r.component_id) for r in got if r.id is not None} == {(i, c) for i, (_, c) in want.items()}
    kept, want = stages.near_copies(spark, odd, SF), brute.near(groups[:40], 80)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{c for _, c in want.values()}, None], key=str)


def test_components(spark):
    """A long chain, a star and a ring, in any order."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 220)] + [(1000 + rng.randrange(1, 300), 1000) for _ in range(400)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(101, 221)) and all(v == 1000 for k, v in got.items() if 1000 < k < 2000)
    assert all(got[2000 + k] == 2000 for k in range(1, 50))


def test_signature_estimates(spark):
    """Bit counts of packed signatures follow the similarity."""
    rng = random.Random(6)
    rows, true = [], []
    for k in range(200):
        common = [f"c{k}.{j}" for j in range(rng.randint(20, 200))]
        a, b = (common + [f"{side}{k}.{j}" for j in range(rng.randint(0, 100))] for side in "ab")
        sets = [np.unique([zlib.crc32(w.encode()) * 2**32 + zlib.crc32(w[::-1].encode()) for w in ws]).astype(np.uint64) for ws in (a, b)]
        sets = [np.unique(minhash.mixed(s)) for s in sets]
        true.append(len(np.intersect1d(*sets)) / len(np.union1d(*sets)))
        rows.append((k, *[minhash.packed(minhash.minima([s]))[0].tolist() for s in sets]))
    d = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    got = np.array([r.e for r in d.orderBy("k").select(minhash.similarity("x", "y").alias("e")).collect()])
    assert np.abs(got - true).max() < 0.16 and abs((got - true).mean()) < 0.01


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    kind = [lambda: rng.randint(1, 2048), lambda: min(2048, int(rng.expovariate(1 / 500)) + 1), lambda: rng.choice([1, 7, 700, 1025, 2048]),
            lambda: rng.randint(1025, 2048), lambda: rng.randint(1, 40), lambda: rng.choice([683, 682, 684])][seed]
    sizes = collections.Counter(kind() for _ in range(4000))
    rows = packing.plan(dict(sizes))
    count, filled, spans = collections.Counter(), collections.defaultdict(int), collections.defaultdict(list)
    for length, rank, n, first, offset in rows.tolist():
        assert rank == count[length]
        count[length] += n
        for s in range(first, first + n):
            filled[s] += length
            spans[s].append((offset, length))
    assert count == sizes and max(filled.values()) <= 2048
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    room, opened = [], 0  # best-fit decreasing, piece by piece
    for length in sorted(sizes.elements(), reverse=True):
        k = bisect.bisect_left(room, length)
        if k == len(room):
            opened += 1
            room.insert(len(room), 2048)
        bisect.insort(room, room.pop(k) - length)
    assert len(filled) <= 1.02 * opened + 2


def test_packed_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", F.lit(1).alias("length"), F.lit("x").alias("row"))
    odd = [(10**9, None, 1, ""), (10**9 + 1, "", 1, ""), (10**9 + 2, "word " * 9000, 1, ""), (10**9 + 2, "word " * 9000, 1, ""), (None, "é <|endoftext|>", 1, "")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, at // 2048, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048)]
    got = packing.pack_documents(docs, ["doc_id"]).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        assert all(o == sum(n for q, n in own if q < o) for o, _ in own) and sum(n for _, n in own) <= 2048
    assert packing.pack_documents(docs.where("false"), ["doc_id"]).count() == 0


PAGES = [(1, "http://a.example/x?y=1", "<p>" + "é" * 1200), (2, "http://a.example/2", "<p>" + "é" * 1200), (5, None, "<p>" + "é" * 1200), (5, None, "<p>" + "é" * 1200),
         (None, "bad\r\nWARC-Type: x", "<p>" + "é" * 1200), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", None), (9, "", ""), (-4, "n", "\r\n\r\nWARC/1.1\r\n" + "q" * 2000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = scratch(spark, "warc-test")
    manifest = warc.write(pages, folder)
    found = warc.read(spark, manifest, folder).cache()
    assert found.groupBy("type").count().where("type != 'warcinfo'").agg(F.sum("count")).first()[0] == 3 * len(PAGES)
    nested = warc.assembled(found).collect()
    assert len(nested) == len(PAGES) and all(r.request.fields is None and r.metadata.fields for r in nested)
    payloads = sorted(bytes(r.response.payload) for r in nested if r.response.type == "response")
    assert payloads == sorted([*["x" * 999] * 2, "", "", "<p>" + "é" * 1200, PAGES[-1][2]], key=lambda s: s.encode()) or payloads == sorted(s.encode() for s in [*["x" * 999] * 2, "", "", "<p>" + "é" * 1200, PAGES[-1][2]])
    assert not any("\n" in (r.response.target or "") for r in nested)
    got = sorted(map(tuple, warc.op8_warc(pages).collect()), key=str)
    sha = lambda s: warc.hashlib.sha1(s.encode()).hexdigest()
    big = PAGES[0][2]
    want = [(5, 2403, sha(big), "response", None)] + [(i, 2403, sha(big), "revisit", 5) for i in (1, 2, 5, None)]
    want += [(i, len(h or ""), sha(h or ""), "response", None) for i, _, h in PAGES[5:]]
    assert got == sorted(want, key=str)
    assert warc.op8_warc(pages.where("false")).count() == 0


def test_warc_reader():
    a = warc.record("metadata", "<urn:x>", "t", "application/warc-fields", b"a: b\r\n", {"WARC-Concurrent-To": "<urn:y>"})
    (head, block), = warc.records(io.BytesIO(gzip.decompress(warc.member(a))))
    assert block == b"a: b\r\n" and warc.parsed(head, block, True)["concurrent_to"] == ["<urn:y>"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(a[:-8])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))


def test_assembly_by_either_side(spark):
    """The response may name the others; a lone request gives no capture, a lone response one without partners."""
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["r1"]), ("m0", "metadata", ["r1"]), ("q9", "request", ["none"]), ("r2", "revisit", [])]
    d = spark.createDataFrame([(i, t, c, None, None, None, None, None, None, None, None) for i, t, c in rows], warc.RECORD)
    got = {r.capture: (r.request and r.request.id, r.metadata and r.metadata.id) for r in warc.assembled(d).collect()}
    assert got == {"r1": ("q1", "m0"), "r2": (None, None)}


def test_blocks():
    page = """<!DOCTYPE html><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script><body class="home">
    <NAV ID=top><ul><li><a href="/x">One</a><li><a href='>'>Two</a></ul></nav><!-- <p>no</p> --><div class="ad  big-Box">A&nbsp;d</div>
    <p>a<br>b <b>c<p>d &lt;e&gt; &#233;&copy</b></p><textarea>no</textarea> f &am <h2>g</h2>h<table><tr><td>i<td>j</table><p>k"""
    got = [(b.text, b.path) for b in blocks(page)]
    body = ("body.home",)
    assert got[:3] == [("One", (*body, "nav.top", "ul", "li")), ("Two", (*body, "nav.top", "ul", "li")), ("A d", (*body, "div.ad.big.box"))]
    assert [t for t, _ in got[3:]] == ["a b c", "d <e> é©", "f &am", "g", "h", "i", "j", "k"]
    assert [b.linked for b in blocks(page)][:3] == [3, 3, 0]
    assert blocks("") == [] and blocks("<p") == [] and [b.text for b in blocks("a < b")] == ["a < b"]
    assert [b.text for b in blocks("<div>" * 3000 + "x" + "</div>" * 3000)] == ["x"]


def article(html):
    """Main text of the test pages, by their own layout."""
    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_html_extraction(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    odd = [(10**9, "u", None), (10**9 + 1, None, ""), (10**9 + 2, "u", "<article><p>" + "<div>" * 5000)]
    got = main_text.op2_html_extraction(pages.union(spark.createDataFrame(odd, pages.schema))).collect()
    want = {r.page_id: article(r.html) for r in pages.collect()} | {i: "" for i, *_ in odd}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)
    w = main_text.fitted(pages)
    other = main_text.examples([r.html for r in table(spark, "/root/testdata/sf0.1", "pages").where("page_id % 40 = 7").collect()], layouts=2, seed=77)
    right = [(q >= main_text.MAIN_FROM) == np.array(y) for q, (_, y) in zip(main_text.probabilities([p for p, _ in other], w), other, strict=True)]
    assert np.concatenate(right).mean() >= 0.95  # layouts that training didn't see
    assert main_text.extract(pages.where("false"), w, ["page_id"]).count() == 0


def test_gradients():
    """Backpropagation through both directions against finite differences."""
    rng = np.random.default_rng(1)
    w = {k: a.astype(float) for k, a in main_text.new_weights(rng).items()}
    rows = [rng.normal(size=(n, main_text.WIDTH)).astype(np.float32) for n in (4, 2)]
    z, (x, xb, live, turn, both, kf, kb) = main_text.logits(rows, w)
    dz = np.where(live, main_text.sig(z) - 1, 0)
    dboth, page = dz[:, :, None] * w["v"], np.arange(2)
    g = main_text.back(x, kf, w, "f", dboth[:, :, :main_text.HIDDEN]) | main_text.back(xb, kb, w, "b", dboth[:, :, main_text.HIDDEN:][turn, page])

    def loss():
        z, (_, _, live, *_) = main_text.logits(rows, w)
        return -np.log(main_text.sig(z[live])).sum()

    for name in ("xf", "hf", "bf", "xb", "hb", "bb"):
        k = np.unravel_index(rng.integers(w[name].size), w[name].shape)
        old = w[name][k]
        w[name][k] = old + 1e-3
        up = loss()
        w[name][k] = old - 1e-3
        down = loss()
        w[name][k] = old
        assert abs((up - down) / 2e-3 - g[name][k]) < 2e-3 + 0.02 * abs(g[name][k]), name


def test_pipeline(spark):
    """run() against the plain definitions, with the quality verdict taken from its own stage."""
    import corpus_pipeline
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect())
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in stages.quality(spark, docs, SF).collect())
    near = brute.near(rows, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [(i, brute.masked(t)) for i, t in rows if not brute.leaks(t, items)[4]]
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, at // 2048, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048)]
    assert got == sorted(want) and 0 < len(rows) < docs.count()


def test_stages_take_empty_tables_and_odd_columns(spark):
    import corpus_pipeline
    docs = table(spark, SF, "documents").withColumn("row", F.lit(1)).withColumn("spans", F.array(F.lit("x"))).withColumn("n_words", F.lit(None).cast("double"))
    for d in (docs.where("false"), docs.limit(30).union(docs.limit(2)).union(docs.limit(1).select(F.lit(None).cast("long"), F.lit(None).cast("string"), *docs.columns[2:]))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns and out.dtypes == d.dtypes, name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0


def test_entry_without_this_subpackage():
    code = ("import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline' or name.startswith('pricelens.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "assert 'signal_board' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and 'op9_minhash' not in e.oracle_sql()")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_ranks_of_a_hot_length(spark):
    """Ranks run from 0 without gaps in every length, and a length has only the salts that its own rows call for."""
    lengths = [7] * 900 + [8] * 31 + list(range(20, 320))
    made = spark.createDataFrame([(x, k // 2) for k, x in enumerate(lengths)], "length int, k long")
    got = {}
    for r in packing.ranked(made, {x: lengths.count(x) for x in set(lengths)}, ["k"], salted=30).collect():
        got.setdefault(r.length, []).append(r["rank"])
    assert {x: sorted(v) for x, v in got.items()} == {x: list(range(lengths.count(x))) for x in set(lengths)}
    assert packing.ranked(made.where("false"), {}, ["k"]).count() == 0
