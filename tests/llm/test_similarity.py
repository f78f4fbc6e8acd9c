"""SimHash and embedding links against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm import shared, simhash
from assay.llm.covertree import Tree, _grow, near_vectors, traverse
from assay.llm.shared import components
from assay.llm.simhash import CROWD, drop_near_copies, fingerprint_table, fingerprints, links, near_groups, similar_groups


def labels_of(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c", "a b c a b c a b", " É x\x0by\x1cz ", "tab\tnew\nline " * 3, "w1 " * 70_000 + "end of it"]
    got = fingerprints([t.encode() if t is not None else None for t in texts])
    assert [g % (1 << 64) for g in got] == [brute_print(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["fp"] for r in fingerprint_table(docs).collect()} == dict(enumerate(got))
    # The hash is the one of Spark's own function.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def linked(fps, got):
    place = {f: i for i, f in enumerate(fps)}
    return labels_of(len(fps), [(place[r["a"]], place[r["b"]]) for r in got])


def test_links_equal_all_pairs_also_in_crowds(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 300, dtype=np.int64)]
    for f in fps[:60]:  # neighbours at one, two and three bits
        for bits in (1, 2, 3):
            g = f % (1 << 64)
            for b in rng.choice(64, bits, replace=False):
                g ^= 1 << int(b)
            fps.append(g - (1 << 64) if g >> 63 else g)
    centre = 0x0F0F0F0F0F0F0F0F  # a crowd: many fingerprints of one grid point, some of them linked
    for i in range(64):
        for j in range(0, 64, 5):
            g = centre ^ (1 << i) ^ (1 << j)
            fps.append(g - (1 << 64) if g >> 63 else g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for most in (2, 1):
        want = labels_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= most])
        assert linked(fps, links(df, most).collect()) == want
    assert len(fps) > 10 * CROWD


def test_near_groups(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.replace("word7 ", "other ")), (9, base.upper()), (1, "quite another text"), (7, None), (2, ""), (None, base), (4, " \t"), (9, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit(2)).withColumn("component", F.lit(3))
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_print(t) for _, t in rows]
    label = labels_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = sorted((str(i), least[g]) for (i, _), g in zip(rows, label, strict=True))
    assert sorted((str(r["id"]), r["component"]) for r in got) == want
    assert near_groups(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_each(spark):
    copy, other = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, other), (None, copy), (None, "lone")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "__part", "c0", "_metadata")})
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((str(r[0]), r[1]) for r in kept.collect()) == [("1", copy), ("2", other), ("None", "lone")]
    named = spark.createDataFrame([("b", copy), ("a", copy), ("c", None), ("d", " "), ("e", "")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in drop_near_copies(named).collect()) == ["a", "c"]
    assert drop_near_copies(docs.limit(0)).count() == 0


def shingled(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def alike(texts, least=0.8):
    sets = [shingled(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(10**6)}"
    return words


@pytest.mark.parametrize(("crowd", "pivots"), [(24, 32), (3, 2)])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, crowd, pivots):
    """Families of edited texts, a passage that many share, short texts and ties, with crowds settled by pivots too."""
    monkeypatch.setattr(simhash, "CROWD_DOCS", crowd)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rng = np.random.default_rng(8)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    texts = []
    for n, size in ((120, 6), (300, 9), (40, 4), (900, 3)):
        base = say(n)
        texts += [" ".join(edited(rng, base, int(rng.integers(0, max(2, n // 40))))) for _ in range(size)]
    passage = say(60)
    texts += [" ".join([*say(40), *passage, *say(40)]) for _ in range(12)]  # a third of each text, far from similar
    base = say(200)
    texts += [" ".join(edited(rng, base, 1)) for _ in range(14)]  # a crowd of near copies
    texts += [" ".join(edited(rng, base, 6)) for _ in range(6)]
    texts += [None, "", " \n", "one two", "One  Two", "one two three four five six", "a b c d e", "a b c d e f", *[" ".join(say(80)) for _ in range(20)]]
    want = labels_of(len(texts), alike(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["label"] for r in similar_groups(rows).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [16, 4096])
def test_crowds_compare_few_pairs(spark, monkeypatch, block):
    """A passage in many texts, some of them similar, and a family with texts too far from most of it: few pairs, every link."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    met, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *more: met.append(pairs.distinct().count()) or verified(pairs, *more))
    rng = np.random.default_rng(9)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, base = say(60), say(150)
    lists = [[*say(40), *passage, *say(40)] for _ in range(150)]
    lists += [edited(rng, lists[i], 2) for i in range(0, 150, 10)]
    lists += [edited(rng, base, int(e)) for e in rng.integers(0, 7, 120)]
    texts = [" ".join(words) for words in lists]
    got = {r["row"]: r["label"] for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == labels_of(len(texts), alike(texts))
    assert sum(met) <= 16 * len(texts)


@pytest.mark.parametrize("one_task", [0, 20, 20_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK", one_task)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)] + [(7, 3), (3, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)} | {5000: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cloud(rng, n, d, groups):
    x = [rng.normal(size=(n, d))]
    for k in groups:
        x.append(rng.normal(size=d) + 0.1 * rng.normal(size=(k, d)))
    x = np.concatenate(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dual_traversal_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n, d, groups in ((200, 3, (20,)), (50, 64, (80, 5)), (0, 8, (60,)), (1, 2, ())):
        a, b = cloud(rng, n, d, groups), cloud(rng, n, d, groups)
        b[: len(b) // 4] = a[: len(b) // 4]
        wa, wb = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
        ta, tb = Tree(a), Tree(b)
        m = a @ b.T >= 0.95
        la, lb, _ = traverse(a, ta, wa, b, tb, wb, 0.95, same=False)
        assert np.array_equal(la, m @ wb) and np.array_equal(lb, m.T @ wa)
        own = a @ a.T >= 0.95
        np.fill_diagonal(own, False)
        la, lb, _ = traverse(a, ta, wa, a, ta, wa, 0.95, same=True)
        assert np.array_equal(la + lb, own @ wa)


def test_dual_traversal_prunes_by_own_radii():
    """Forty tight clusters far apart: all but the pairs of nodes within a cluster go, and few are opened."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(40, 32))
    x = np.repeat(c / np.linalg.norm(c, axis=1, keepdims=True), 50, axis=0) + 0.04 * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen: dict = {}
    t, w = Tree(x), np.ones(len(x))
    la, lb, _ = traverse(x, t, w, x, t, w, 0.95, same=True, seen=seen)
    own = x @ x.T >= 0.95
    np.fill_diagonal(own, False)
    assert np.array_equal(la + lb, own.sum(axis=1)) and seen["judged"] < len(x) ** 2 / 20


def test_vectors_of_any_finite_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [-1e200, 1e200]), (6, [1e308, -1e308])]
    got = {r["id"]: (r["n_links"], r["component"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_upper_tree_covers_its_points(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([cloud(rng, 900, 12, ()), 1e-4 * rng.normal(size=(400, 12)) + rng.normal(size=12)])
    df = spark.createDataFrame([(i, v.tolist(), 1.0, 12) for i, v in enumerate(x)], "key long, v array<double>, m double, dim int")
    placed, tree = _grow(df, 64)
    nodes = {r["node"]: r for r in tree.collect()}
    of = {r["key"]: r["node"] for r in placed.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = {}
    for k, n in of.items():
        sizes[n] = sizes.get(n, 0) + 1
        while n is not None:
            if nodes[n]["centre"] is not None:
                assert np.linalg.norm(u[k] - np.array(nodes[n]["centre"])) <= nodes[n]["cover"] + 1e-9
            n = nodes[n]["parent"]
    assert len(of) == 1300 and max(sizes.values()) <= 64 and len(sizes) > 1300 // 64


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = cloud(rng, 60, 6, (40, 8)).astype(np.float32).tolist()
    x += [x[0], x[0], x[70], [2 * v for v in x[5]]]
    odd = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [], [1.0, 0.0]]
    rows = [(1000 - i, v) for i, v in enumerate(x)] + [(i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("key", F.lit(2))
    u = np.array([np.array(v, np.float64) for v in x])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    m = u @ u.T >= 0.95
    np.fill_diagonal(m, False)
    label = labels_of(len(u), list(zip(*np.nonzero(m), strict=True)))
    least = {}
    for i, g in enumerate(label):
        least[g] = min(least.get(g, 10**9), 1000 - i)
    want = {1000 - i: (int(m[i].sum()), least[g]) for i, g in enumerate(label)} | {i: (0, i) for i in range(len(odd))}
    for block in (2048, 7):
        got = {r["id"]: (r["n_links"], r["component"]) for r in near_vectors(df, block=block).collect()}
        assert got == want
    assert near_vectors(df.limit(0)).count() == 0
