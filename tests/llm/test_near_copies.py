"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from nestquery.llm import simhash_gph
from nestquery.llm.common import smallest_labels

DOC = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def same(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def test_stage_equals_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(500)]
    texts = ["", None, "one two", "One  two"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(6, 400))]
        for edits in (0, 0, 1, 2, 4, 8):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    near = np.array([[same(a, b) for b in sets] for a in sets])
    a, b = np.nonzero(near)
    label = smallest_labels(a, b, len(rows))
    assert len(set(label)) < len({frozenset(s) for s in sets}) - 20  # edited copies, not only exact ones
    df = spark.createDataFrame(rows, DOC).repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(set(label.tolist()))


@pytest.mark.parametrize("most", [0, 500_000])
def test_ids_that_repeat(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_gph, "BROADCAST_ROWS", most)
    a, b, c = "a b c d e f g", "something else entirely here", "alone in the world it is"
    rows = [(7, a), (7, a), (7, b), (None, a), (None, c), (None, c), (9, b), (3, c)]
    kept = simhash_gph.keep_one(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == [(3, c), (7, a), (7, b)]
    assert simhash_gph.keep_one(spark.createDataFrame([], DOC)).count() == 0


def test_blocks_of_a_large_group(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # near the base, less so each other
        w = list(base)
        w[r.randrange(5, 75)] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    a, b = np.nonzero(np.array([[same(x, y) for y in sets] for x in sets]))
    want = len(set(smallest_labels(a, b, len(rows)).tolist()))
    for block in (2048, 7):
        got = simhash_gph.similar(spark.createDataFrame(rows, DOC), block=block)
        assert got.select("component").distinct().count() == want
