"""The pipeline's near-duplicates, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from presslens.llm import set_similarity, simhash
from tests.llm.test_operators import DOCS, brute_fingerprint, empty, odd_documents, text


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def brute_groups(rows):
    """The smallest doc_id of each doc_id's group; rows are (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    links = [(i, j) for i, j in combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in rows:
        before = dict(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return root
    return root


@pytest.mark.parametrize("leaders", [(1, 4, 64), (1,), ()])
def test_similar_documents(spark, leaders, monkeypatch):
    monkeypatch.setattr(set_similarity, "LEADERS", leaders)
    monkeypatch.setattr(set_similarity, "SMALL", 3)
    rng = random.Random(5)
    base = [text(rng, n) for n in (6, 12, 40, 80, 200, 400)]
    boiler = text(rng, 30)
    rows = []
    for i in range(160):
        w = base[i % 6].split()
        for _ in range(rng.randint(0, 1 + len(w) // 30)):  # similarities on both sides of the threshold
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w) + (" " + boiler if i % 4 == 0 else "")))
    rows += [(200 + i, text(rng, 20) + " " + boiler) for i in range(20)] + [(300, None), (301, ""), (302, " \n")]
    got = {r.doc_id: r.component_id for r in set_similarity.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows) and 1 < len(set(got.values())) < len(rows)


def test_stage_catches_copies_beyond_four_bits(spark):
    import corpus_pipeline

    rng = random.Random(6)
    rows = []
    while len(rows) < 40:
        a = text(rng, 120).split()
        b = a[:60] + ["changed"] + a[61:]
        pair = [" ".join(a), " ".join(b)]
        if (brute_fingerprint(pair[0]) ^ brute_fingerprint(pair[1])).bit_count() > 4 and 5 * len(shingles(pair[0]) & shingles(pair[1])) >= 4 * len(shingles(pair[0]) | shingles(pair[1])):
            rows += [(len(rows) + n, t, "en", "s", 0) for n, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = dict(corpus_pipeline.STAGES)["drop_near_duplicates"](spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2)) and kept.columns == docs.columns


def test_odd(spark):
    d = odd_documents(spark)
    assert set_similarity.similar_documents(d).count() == d.count()
    kept = simhash.drop_near_duplicates(d, similarity=0.8, k=5)
    assert kept.columns == d.columns and kept.where("doc_id IS NULL").count() == d.where(F.col("doc_id").isNull()).count()
    assert simhash.drop_near_duplicates(empty(spark), similarity=0.8, k=5).count() == 0
