"""Operators 1 and 6 against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nestquery.llm import common, pq_dedup, simhash_gph
from nestquery.llm.common import connected_components, smallest_labels, spanning_edges

VEC = "vec_id long, embedding array<float>, label int, kept string"
DOC = "doc_id long, text string, fp string"


def fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    a, b = np.nonzero(linked)
    label = smallest_labels(a, b, len(ids))
    least = {}
    for i, l in zip(ids, label):
        least[l] = min(least.get(l, i), i)
    return {i: least[l] for i, l in zip(ids, label)}


def vectors():
    r = np.random.default_rng(3)
    out = []
    for label in (0, 1, None):
        for c in range(6):
            centre = r.normal(size=16)
            out += [(centre + r.normal(size=16) * s, label) for s in (0, 0, 0.02, 0.05, 0.05, 0.1, 0.2, 0.4)]
    out += [(np.zeros(16), 0), (np.array([np.nan] * 16), 1), (np.array([np.inf] + [0] * 15), 1), (out[0][0] * 7, 0), (out[0][0][:8], 0), (out[0][0][:8], 0)]
    return [(i, x.astype(np.float32).tolist(), l, "x") for i, (x, l) in enumerate(out)] + [(900, None, 0, None), (901, [], 0, None), (902, [None, 1.0], 0, None)]


@pytest.mark.parametrize("block, list_rows", [(2048, 4096), (5, 10), (3, 1000)])
def test_vectors(spark, block, list_rows):
    rows = vectors()
    got = {r.vec_id: r for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, VEC).repartition(3), block=block, list_rows=list_rows).collect()}
    assert len(got) == len(rows)

    def cos(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] or None in b[1]:
            return -1
        x, y = np.array(a[1], float), np.array(b[1], float)
        with np.errstate(all="ignore"):
            c = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))
        return c if np.isfinite(c) else -1

    linked = np.array([[i != j and cos(a, b) >= 0.98 for j, b in enumerate(rows)] for i, a in enumerate(rows)])
    comp = components([r[0] for r in rows], linked)
    assert linked.sum() > 20
    for r, n in zip(rows, linked.sum(1)):
        g = got[r[0]]
        assert (g.n_links, g.component_id, g.kept) == (n, comp[r[0]], comp[r[0]] == r[0])


def test_vectors_empty_and_repeated(spark):
    assert pq_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
    rows = [(5, [1.0, 0.0], 1, ""), (5, [1.0, 0.0], 1, ""), (3, [1.0, 0.01], 1, ""), (None, [1.0, 0.0], 1, ""), (8, [1e-30, 0.0], 1, "")]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, VEC)).collect()), key=repr)
    assert got == [(3, 4, 3), (5, 4, 3), (5, 4, 3), (8, 4, 3), (None, 4, 3)]


def test_quantiser_keeps_every_link():
    r = np.random.default_rng(0)
    x = pq_dedup._unit(r.normal(size=(400, 12)))
    y = pq_dedup._unit(x + r.normal(size=x.shape) * 0.03)
    q = pq_dedup.Quantiser(x, 9)
    own_x, rows, lists = q.lists(x, 0.2)
    own_y = q.lists(y, 0.2)[0]
    probes = set(zip(rows.tolist(), lists.tolist()))
    rows, lists = q.lists(y, 0.2)[1:]
    back = set(zip(rows.tolist(), lists.tolist()))
    for i in np.flatnonzero(((x - y) ** 2).sum(1) <= 0.04):
        assert own_x[i] == own_y[i] or (i, own_y[i]) in probes or (i, own_x[i]) in back


def documents():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 300))]
        for k in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((" ", "\n\t ")[k % 2].join(w).upper() if k == 2 else " ".join(w))
    out += ["", None, " \n ", "one", "One", "a b c d", "é É"]
    return [(i * 3 % 1009, t, "x") for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [4096, 4])
def test_simhash(spark, block):
    rows = documents()
    got = {r.doc_id: r for r in simhash_gph.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), block=block).collect()}
    fp = np.array([fingerprint(r[1]) for r in rows], np.uint64)
    comp = components([r[0] for r in rows], np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    assert len(set(comp.values())) < len(rows) - 10
    for r, f in zip(rows, fp.tolist()):
        assert (got[r[0]].fp & (2**64 - 1), got[r[0]].component_id) == (f, comp[r[0]])


def test_simhash_links_are_complete(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            fps.add(b ^ sum(1 << x for x in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    a = np.array(fps, np.int64).view(np.uint64)
    want = components(fps, np.bitwise_count(a[:, None] ^ a[None]) <= 4)
    for block in (4096, 16):
        got = {x.node: x.component for x in connected_components(simhash_gph.links(df, 4, block)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


@pytest.mark.parametrize("n", [10, 10**6, 10**10])
def test_thresholds_keep_the_pigeonhole(n):
    r = np.random.default_rng(2)
    bits = r.random((500, 64)) < 0.5
    both = (bits.T.astype(float) @ bits) / 500 * n
    plan = simhash_gph.allocate(n, both, 4)
    assert sum(t + 1 for _, t in plan) == 5
    flat = [b for bits_, _ in plan for b in bits_]
    assert len(flat) == len(set(flat))
    if n == 10**10:
        assert min(len(b) for b, _ in plan) > 12  # wider partitions for more rows


def test_simhash_empty_and_nulls(spark):
    assert simhash_gph.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e f", ""), (7, "a b c d e f", ""), (7, "a b c d e f", ""), (7, "something else entirely here", ""), (None, "alone in the world it is", "")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_gph.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=repr)
    assert got == sorted([(7, 7), (7, 7), (7, 7), (None, 7), (None, None)], key=repr)


@pytest.mark.parametrize("native", [True, False])
def test_components_of_chains_and_stars(spark, native):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").withColumn("r", F.rand(1)).orderBy("r").select("a", "b")
    got = {r.node: r.component for r in connected_components(df, native).collect()}
    assert connected_components(df.limit(0), native).count() == 0
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def test_operators_by_rounds(spark, monkeypatch):
    """Beyond the edges of one task: the same components, copies and links."""
    monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    rows = documents()
    got = {r.doc_id: r.component_id for r in simhash_gph.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    fp = np.array([fingerprint(r[1]) for r in rows], np.uint64)
    assert got == components([r[0] for r in rows], np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)


def test_spanning_edges():
    a, b = spanning_edges(np.array([5, 9, 7, 5]), np.array([9, 7, 5, 9]))
    assert len(a) == 2 and set(b.tolist()) == {5}
