"""The near-copy stage's own threshold, 0.8, against all pairs."""

import random

import brute
import pytest
from test_groups_pages import SF, edited, groups  # noqa: F401

from pricelens.llm import minhash, stages


def similar(x, y):
    return len(x & y) / len(x | y)


def near(rows, threshold):
    """id -> smallest id reachable, and the similarities of all pairs below 1."""
    sets, root, seen = {i: brute.shingles(t) for i, t in rows}, {i: i for i, _ in rows}, []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if sets[i] and sets[j]:
                seen.append(similar(sets[i], sets[j]))
                if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: top(i) for i in ids}, seen


@pytest.fixture(scope="module")
def pairs():
    """Pairs with one changed stretch, 0.786 to 0.852 similar: 98 to 100 shingles each, 8 to 12 of them lost."""
    rng, rows = random.Random(8), []
    for k in range(60):
        base = [f"p{k}.{j}" for j in range(rng.choice([102, 103, 104]))]
        rows += [base, edited(rng, base, rng.randint(4, 8) / len(base), rng.randrange(10, 80))]
    exact = [f"x{j}" for j in range(103)]  # 99 shingles, 11 lost: exactly 0.8
    rows += [exact, exact[:40] + [f"y{j}" for j in range(7)] + exact[47:]]
    return [(k + 1, " ".join(w)) for k, w in enumerate(rows)]


def test_stage_drops_near_copies_from_0_8(spark, pairs):
    want, seen = near(pairs, 80)
    assert sum(0.8 <= s < 0.85 for s in seen) > 20 and 0.8 in seen and any(0.75 < s < 0.8 for s in seen)
    kept = stages.near_copies(spark, spark.createDataFrame(pairs, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_copies_at_0_8(spark, groups, monkeypatch):  # noqa: F811
    want, _ = near(groups, 80)
    assert want != near(groups, 85)[0]
    d = spark.createDataFrame(groups, "doc_id long, text string")
    for small in (minhash.SMALL, 2):
        monkeypatch.setattr(minhash, "SMALL", small)
        assert {r.id: r.component_id for r in minhash.near_copies(d, threshold=80).collect()} == want


def family(kind, n):
    """Members with own edits (most pairs below the threshold), or one passage in texts that are else their own."""
    rng, base = random.Random(n), [f"w{k}" for k in range(100)]
    if kind == "edits":
        rows = []
        for _ in range(n):
            w = list(base)
            for k in rng.sample(range(100), rng.randint(2, 4)):
                w[k] = f"x{rng.randrange(10**9)}"
            rows.append(w)
        return rows
    return [base[:60] + [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(5, 40))] for _ in range(n)]


@pytest.mark.parametrize(("kind", "threshold"), [("edits", 80), ("edits", 85), ("passage", 80)])
def test_candidates_grow_with_the_family_not_its_square(spark, monkeypatch, kind, threshold):
    """Twice the members: no more than 2.3 times the pairs and the exploded shingles, and the right links."""
    made = {}

    def counted(name, size):
        plain = getattr(minhash, name)

        def run(*args, **kw):
            out = plain(*args, **kw)
            made[name] = made.get(name, 0) + size(out)
            return out

        monkeypatch.setattr(minhash, name, run)

    counted("listed_pairs", lambda d: d.count())
    counted("meeting_pairs", lambda d: d.count())
    counted("likely", lambda d: d.count())
    counted("meetings", lambda d: d.count())
    counted("referred", lambda d: d.selectExpr("sum(size(d))").first()[0] or 0)
    sizes = []
    for n in (400, 800):
        made.clear()
        rows = [(k, " ".join(w)) for k, w in enumerate(family(kind, n))]
        got = {r.id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()}
        assert got == near(rows, threshold)[0]
        sizes.append(dict(made))
    small, large = sizes
    assert large.get("referred", 0) <= 2.3 * max(small.get("referred", 0), 2000), sizes
    pairs = [sum(n for name, n in x.items() if name != "referred") for x in sizes]
    assert pairs[1] <= 2.3 * pairs[0], sizes
