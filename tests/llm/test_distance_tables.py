"""The tables of distances to references at the pipeline's radius: they lose nothing, and do discard."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from presslens.llm import set_similarity
from presslens.llm.simhash import references
from tests.llm.test_operators import text
from tests.llm.test_set_similarity import brute_groups

RADIUS = 24


def fingerprints(rng, n):
    """Random ones, each with others at 0 to 40 bits."""
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(5):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 40)):
                x ^= 1 << b
            out.append(x)
    return np.array(out, np.uint64)


@pytest.fixture
def seen(monkeypatch):
    """What the tables were asked and let through: (pairs, undiscarded)."""
    counts, undiscarded = [], set_similarity.undiscarded

    def spy(x, y, radius):
        out = undiscarded(x, y, radius)
        counts.append((len(out), int(out.sum())))
        return out

    monkeypatch.setattr(set_similarity, "undiscarded", spy)
    return counts


def test_tables_keep_what_is_near():
    refs, rng = references(16), random.Random(1)
    fp = fingerprints(rng, 400)
    table = set_similarity.distance_tables(fp, refs)
    for r, x, b in [(0, 0, 0), (15, 399, 7), (7, 123, 3)]:
        assert table[r, x, b] == ((int(refs[r]) ^ int(fp[x])) >> 8 * b & 255).bit_count()
    for i in range(len(fp)):
        apart = np.bitwise_count(fp ^ fp[i])
        stays = set_similarity.undiscarded(table, table[:, i : i + 1], RADIUS)
        assert stays[apart <= RADIUS].all() and stays[apart > 28].mean() < 0.2


def test_pairs_of_a_shingle_go_through_the_tables(seen):
    fp = fingerprints(random.Random(2), 60)
    n = len(fp)
    cols = [np.zeros(n), np.arange(n), np.arange(n), np.full(n, 50), np.zeros(n), fp.view(np.int64)]  # token, root, sig, n, at, fp
    batch = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["token", "root", "sig", "n", "at", "fp"])
    got = {(a, b) for out in set_similarity._apart(0.8, RADIUS, references(16))(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    assert got == {(i, j) for i, j in combinations(range(n), 2) if int(fp[i] ^ fp[j]).bit_count() <= RADIUS}
    asked, stay = map(sum, zip(*seen))
    assert asked == n * (n - 1) // 2 and len(got) <= stay < asked / 2


def test_pairs_with_a_leader_go_through_the_tables(seen):
    fp = fingerprints(random.Random(3), 60)
    i, j = map(np.array, zip(*combinations(range(len(fp)), 2)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, fp[i].view(np.int64), fp[j].view(np.int64))], names=["a", "b", "fp", "fp_b"])
    got = [p for out in set_similarity._near(RADIUS, references(16))(iter([batch.slice(0, 0), batch])) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert got == [(a, b) for a, b in zip(i.tolist(), j.tolist()) if int(fp[a] ^ fp[b]).bit_count() <= RADIUS]
    asked, stay = map(sum, zip(*seen))
    assert asked == len(i) and len(got) <= stay < asked / 2


@pytest.mark.parametrize("refs", [1, 16])
def test_groups_don_t_depend_on_the_references(spark, refs, monkeypatch):
    monkeypatch.setattr(set_similarity, "SMALL", 3)
    rng = random.Random(4)
    boiler, rows = text(rng, 12), []
    for i in range(60):
        w = text(rng, 60).split()
        for j in range(3):
            rows.append((3 * i + j, f"{' '.join(w)} {boiler}"))
            w[rng.randrange(len(w))] = f"new{i}{j}"
    got = {r.doc_id: r.component_id for r in set_similarity.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), refs=refs).collect()}
    assert got == brute_groups(rows) and 60 <= len(set(got.values())) < len(rows)
