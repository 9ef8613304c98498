"""Prefix trie, manifest and exact dedup against plain definitions."""

import hashlib
import random
import re
import zlib

import pytest

from pricelens.llm import exact_dedup, manifest, prefix_trie
from pricelens.llm.common import shared_prefix

GAPLESS = re.compile("[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def test_shared_prefix():
    rng = random.Random(1)
    for _ in range(2000):
        n, pad = rng.randrange(60), rng.randrange(4)
        a = bytes(rng.randrange(256) for _ in range(n))
        x, y = a + b"x" * rng.randrange(20), b"z" * pad + a + b"y" * rng.randrange(20)
        assert shared_prefix(x, 0, y, pad) == n or n == 0 and shared_prefix(x, 0, y, pad) == 0


@pytest.mark.parametrize("spread", [3, 12, 40, 256])
def test_radix_tree_holds_its_keys(spread):
    """Any insertion order, all layouts, keys that are prefixes of others."""
    rng, tree, want = random.Random(spread), prefix_trie.Tree(), {}
    for k in range(3000):
        key = bytes(rng.randrange(spread) for _ in range(rng.randrange(5)))
        tree.add(key, k)
        want.setdefault(key, []).append(k)
    got, kinds, stack = {}, set(), [(tree.root, b"")]
    while stack:
        node, before = stack.pop()
        key = before + node.label
        kids = list(node.kids.items())
        kinds.add(type(node.kids).__name__ + (str(node.kids.room) if isinstance(node.kids, prefix_trie.Few) else ""))
        assert [b for b, _ in kids] == sorted(b for b, _ in kids)
        assert node.ends or len(kids) > 1  # no path without a branch is a node
        if node.ends:
            got[key] = list(node.ends)
        stack += [(kid, key + bytes([b])) for b, kid in kids]
    assert got == want
    assert {3: "Few4", 12: "Few16", 40: "Some", 256: "Full"}[spread] in kinds


def trie(rows):
    """Every node of the trie of whole conversations, from the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    ident = lambda t: sha(f"{len(t[0])}:{t[0]}{t[1]}")
    own = {c: [t for _, t in sorted(ts, key=lambda x: (x[0], ident(x[1])))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        below, stack = [], [p]
        while stack:
            q = stack.pop()
            below.append(q)
            stack += kids.get(q, [])
        saved = sum((len(members[q]) - 1) * len(GAPLESS.findall(q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(q not in kids for q in below), saved, sha(ends)))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, key int, run string"


def conversations(n, seed, longest=9):
    rng, rows = random.Random(seed), []
    common = [("user", "hello there you"), ("assistant", "yes  what\tis it"), ("user", "tell me"), (None, None), ("user", "")]
    for c in range(n):
        kind = rng.random()
        if kind < 0.1:
            continue
        length = rng.randint(1, longest)
        turns = [common[k % 5] if kind < 0.6 or rng.random() < 0.5 else (rng.choice(["user", "assistant"]), f"text {rng.randrange(6)}") for k in range(length)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(7, None, "user", "before"), (7, 3, "user", "tie a"), (7, 3, "user", "tie b"), (7, 3, "user", "tie b"), (None, 1, "user", "nobody's"), (41, 0, "user", "word " * 20000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run_rows", [100_000, 7, 1])
def test_prefix_trie(spark, monkeypatch, run_rows):
    """One run, some, and one run for each conversation: shared nodes add up to the same."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run_rows)
    rows = conversations(130, 5) + [(c, k, "user", f"deep {k}") for c in (400, 401, 402) for k in range(300 - (c == 401))]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, prefix_trie.op11_prefix_trie(d).collect()), key=str)
    want = trie(rows)
    assert got == want
    assert sum(r[3] for r in want if r[1] == 0) == len({r[0] for r in rows if r[0] is not None})


def test_prefix_trie_of_equal_conversations(spark, monkeypatch):
    """Most conversations are the same: their ends are hashed over several runs. Turnless ones end at the root."""
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 10)
    rows = [(c, k, "user", f"t{k}") for c in range(200) for k in range(3)] + [(c, 0, "user", "only") for c in range(1001, 1060) if c % 20]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, prefix_trie.op11_prefix_trie(d).collect()), key=str)
    assert got == trie(rows) and any(r[1] == 0 and r[7] != sha("") for r in got)


def test_prefix_trie_edges(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.op11_prefix_trie(d).collect() == []
    one = spark.createDataFrame([(None, None, None, None, 1, "x"), (-3, None, None, None, 1, "x")], SCHEMA)
    rows = [(-3, None, None, None)]
    own = [(r.conv_id, r.depth, r.n_convs) for r in prefix_trie.op11_prefix_trie(one).collect()]
    assert sorted(own) == sorted((r[0], r[1], r[3]) for r in trie(rows))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_rows(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def up(nodes):
        """levels of a tree from its leaves"""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, at):
        out = []
        for level in tree[:-1]:
            a = at // 8 * 8
            out.append(("".join(level[a:at]), "".join(level[at + 1:a + 8])))
            at //= 8
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = up([leaf(r) for r in langs[x]])
    top = up([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for at, r in enumerate(langs[x]):
            path = siblings(trees[x], at) + siblings(top, k)
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(changed)
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = "en" if rng.random() < 0.7 else rng.choice([None, "", "é", "de", "z", f"l{rng.randrange(30)}"])
        rows.append((k * 3 + 1, rng.choice(["web", None]), lang, rng.choice([5, None]), rng.choice([f"Text É {k}", "plain", "", None, "ABC"])))
    rows += [rows[3], rows[3], (rows[5][0], "other", "en", 1, "twice"), (None, None, None, None, None), (None, "x", "en", 2, "Null id")]
    return rows + [(10**9, "long", "en", 3, "Wide " * 100_000)]


@pytest.mark.parametrize("deep", [1, 4])
def test_manifest(spark, deep):
    """With blocks of 8 leaves the tree is climbed in several rounds."""
    rows = documents(300, 3)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, at int")
    got = sorted(map(tuple, manifest.manifest(d, deep).collect()), key=str)
    assert got == manifest_rows(rows)
    assert 0 < sum(not r[6] for r in got) < len(got) / 3


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", 1, "Some Text") for k in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, manifest.op12_merkle_manifest(d).collect()), key=str) == manifest_rows(rows)


def test_versions_share_untouched_nodes():
    """A version adds a leaf and its ancestors, and changes nothing that is there."""
    tree = manifest.Versions([sha(str(k)) for k in range(600)], 4)
    hashes, kids, root = list(tree.hash), list(tree.kids), tree.root
    for at in (0, 7, 311, 599):
        before = len(tree.hash)
        new = tree.put(root, at, sha("other"))
        assert len(tree.hash) == before + 5
        assert tree.hash[new] == manifest.folded(sha("other"), tree.siblings(root, at)) != tree.hash[root]
        assert tree.hash[tree.put(new, at, sha(str(at)))] == tree.hash[root]
    assert tree.hash[:len(hashes)] == hashes and tree.kids[:len(kids)] == kids


def dedup_rows(rows):
    norm = [re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[t], len(groups[t]), i == least[t], sha(t)) for (i, _), t in zip(rows, norm)), key=str)


def repeated(seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "a", "a ", "a  b", "a\n\x0bb", "a b", "aéb", "x" * 300_000, "x" * 299_999 + "y", *[f"text {rng.randrange(10**9)} of some length" * 3 for _ in range(80)]]
    rows = [(k, rng.choice(texts)) for k in range(900)] + [(k, "one text that many hold") for k in range(2000, 2600)]
    rows += [(2000, "one text that many hold"), (None, "nobody's"), (None, "nobody's"), (None, "a"), (3, "id three again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_exact_dedup(spark, monkeypatch, limit):
    """With a limit below a few texts, shares are many, the common text goes by salts, and subtrees are given up."""
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", limit)
    rows = repeated(4)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, share string, digest int").repartition(60)
    assert sorted(map(tuple, exact_dedup.op13_exact_dedup(d).collect()), key=str) == dedup_rows(rows)


def test_exact_dedup_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.op13_exact_dedup(d).collect() == []


def test_trie_gives_up_subtrees():
    """What is given up and what is left are all that was put in, once, and later keys don't come back."""
    rng, t, want, out = random.Random(9), exact_dedup.Trie(), set(), []
    for k in range(400):
        key = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
        want.add(key)
        node = t.terminal(key)
        if node is None:
            out.append(key)
        else:
            node.value = 1
            if t.size > 200:
                out += [x for x, _ in t.give_up()]
    left = [x for x, _ in t.items()]
    assert set(left) | set(out) == want and not set(left) & set(out) and left and out
