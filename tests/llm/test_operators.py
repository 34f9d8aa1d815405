"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import glob
import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from presslens.llm import decontamination, langid, line_dedup, metric_join, mixing, packing, queries, sharding, simhash, tokens, warc
from presslens.operators import components
from tests.conftest import same_rows

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = queries.vocabulary()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x"]) for _ in range(n))


def odd_documents(spark):
    """Null ids, texts and sources; empty, blank and long texts; a repeated row; columns whose names operators use."""
    rng = random.Random(5)
    rows = [(None, "no id at all here", "en", "s1", 1), (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "  \n\t ", "en", "s2", 3), (4, text(rng, 6000), "en", "s1", 9), (5, "one", "de", None, 3), (5, "one", "de", None, 3), (6, "<|endoftext|> x'll  two　three 😀\n\n", "fr", "s2", 5)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("size", "target", "copies", "shard", "slot", "component_id", "fp", "n_lines", "removed", "item_ids", "lang_pred", "score", "rejected", "source_size", "rep", "key"):
        d = d.withColumn(c, F.lit("own"))
    return d


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 2: token counts


def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def test_every_code_point_is_cut_as_the_library_does():
    e, t = tokens.encoder(VOCABULARY), library()
    texts = [f"a{chr(c)}b {chr(c)} x{chr(c)}{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for x, y in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.count(x) == len(y.ids), x


def test_random_texts_have_the_library_s_ids():
    rng, e, t = random.Random(1), tokens.encoder(VOCABULARY), library()
    alphabet = [*"ab zZé'sß1²½\n\t    .,!😀\x1c\x85​　中ñ", "<|endoftext|>", "'ll", "the", " of", "  "]
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        want = t.encode(x, add_special_tokens=False).ids
        assert e.encode(x).tolist() == want and e.count(x) == len(want), repr(x)


def test_proven_strings_are_one_token():
    m = tokens.merger(VOCABULARY)
    t = library()
    sample = random.Random(2).sample(sorted(m.whole), 500)
    assert all(t.encode(s, add_special_tokens=False).ids == [m.whole[s]] for s in sample)
    merge = tokens.compiled_merges(m)
    assert all(list(merge(w.encode())) == m.merge(w.encode()) for w in [" ouwhea", "rndthrel", "é", " zzzzz"])


def test_count_tokens(spark, sf):
    t = library()
    for d in (odd_documents(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
        got = tokens.count_tokens(d, VOCABULARY).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(empty(spark), VOCABULARY).count() == 0


# 1: packing


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.randint(1, 40)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        bins, rooms = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the same by search over all bins
            fits = [(r, b) for b, r in enumerate(rooms) if r >= lengths[i]]
            best = min((r for r, _ in fits), default=None)
            b = max((b for r, b in fits if r == best), default=None)
            if b is None:
                bins.append([i])
                rooms.append(cap - lengths[i])
            else:
                bins[b].append(i)
                rooms[b] -= lengths[i]
        got = packing.best_fit_decreasing(lengths, cap)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= cap for b in got)
        assert len(got) == len(bins)


@pytest.mark.parametrize("capacity, block", [(2048, 1 << 21), (64, 500)])
def test_packing_loses_nothing(spark, sf, capacity, block, tmp_path):
    d = odd_documents(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    packing.write_packed(packing.pack(d, VOCABULARY, capacity, 50256, block), f"{tmp_path}/packed")
    rows = spark.read.parquet(f"{tmp_path}/packed").collect()
    parts = {}
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == 2 * capacity and r.cu_seqlens[-1] == r.n_tokens <= capacity and len(r.cu_seqlens) == r.n_segments + 1
        pos = np.frombuffer(r.position_ids, "<u2").tolist()
        assert pos[: r.n_tokens] == [p for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for p in range(b - a)] and not any(pos[r.n_tokens :])
        assert set(np.frombuffer(r.input_ids, "<u2")[r.n_tokens :].tolist()) <= {50256}
        for doc, c, ids in packing.unpack(r):
            parts.setdefault(doc, []).append((c, ids))
    e = tokens.encoder(VOCABULARY)
    want = Counter()
    for r in d.collect():
        want[r.doc_id] += tokens.encoder(VOCABULARY).count(r.text)
        if r.doc_id != 5:  # that one repeats
            assert [t for _, ids in sorted(parts.get(r.doc_id, [])) for t in ids] == e.encode(r.text).tolist()
    assert sum(len(ids) for p in parts.values() for _, ids in p) == sum(want.values())
    assert len({r.bin_id for r in rows}) == len(rows)
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


# 3: sharding


def test_lookup_table_takes_turns():
    names = [f"n{i}" for i in range(7)]
    t = sharding.lookup_table(names, 211)
    n = Counter(t)
    assert set(t) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    want, nxt = [None] * 211, {k: iter([(sharding._number(f"offset:{s}") + j * (sharding._number(f"skip:{s}") % 210 + 1)) % 211 for j in range(211)]) for k, s in enumerate(names)}
    while None in want:
        for k in range(7):
            at = next((i for i in nxt[k] if want[i] is None), None)
            if at is not None:
                want[at] = k
    assert t == want
    fewer = sharding.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(t, fewer)) < 2.5 * 211 / 7  # hardly more than the slots of the one that left
    for bad in (lambda: sharding.lookup_table(names, 210), lambda: sharding.lookup_table([], 211), lambda: sharding.lookup_table(["a", "a"], 211)):
        with pytest.raises(ValueError):
            bad()


def test_shard(spark, tmp_path):
    d = odd_documents(spark)
    out = sharding.shard(d, 4, 211)
    rows = out.collect()
    assert len(rows) == d.count() and out.columns == [c for c in d.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(4)], 211)
    for r in rows:
        at = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 211
        assert (r.slot, r.shard) == (at, table[at])
    assert "Python" not in out._jdf.queryExecution().toString()
    sharding.write_shards(out, f"{tmp_path}/shards", 2)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.shard(empty(spark)).count() == 0


# 4: mixing


def level(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 20000]) for i in range(11)} | {None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3.0).collect()}
    want = level(sizes)
    assert got == {s: pytest.approx(want[s], abs=1e-5) for s in sizes}


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, rng.choice([1, 5, 20, 60])), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    drawn = mixing.draw(d, cell=50).collect()
    assert len(drawn) == 3000
    by = {}
    for r in drawn:
        assert r.size == len(r.text.split()) and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    want = level({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s], abs=1e-5) and {r.target for r in x} == {x[0].target}
        assert sum(r.copies * r.size for r in x) == pytest.approx(want[s], rel=0.02)
        rate = x[0].target / x[0].source_size
        assert {r.copies for r in x} <= {math.floor(rate), math.ceil(rate)}
    assert sorted((r.doc_id, r.copies) for r in drawn) == sorted((r.doc_id, r.copies) for r in mixing.draw(d.repartition(7), cell=50).collect())
    assert mixing.mix(d, cell=50).count() == sum(r.copies for r in drawn) and mixing.mix(d).columns == d.columns


def test_mix_odd(spark):
    d = odd_documents(spark)
    r = mixing.draw(d).collect()
    assert len(r) == d.count() and {x.target for x in r if x.source == "s2"} and all(x.size == len((x.text or "").replace("　", "_").split()) for x in r)
    assert mixing.draw(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", None), (2, " ", None, "b", None)], DOCS)
    assert [(x.size, x.target, x.copies) for x in mixing.draw(blank).collect()] == [(0, 0.0, 0)] * 2


# 5: WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c", "é" * 5000), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same"), (3, "http://c", "é" * 5000), (7, "u", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").withColumn("payload", F.lit("own")).withColumn("sha", F.lit(1))
    warc.write_bundles(pages, f"{tmp_path}/w", frame_bytes=300, bundle_bytes=2000)
    assert warc.name_bundles(spark, f"{tmp_path}/w") > 1
    got = warc.read_records(spark, f"{tmp_path}/w", payloads=True).collect()
    assert len(got) == len({r.record_id for r in got}) == 9
    for r in got:
        payload = {"1": "same", "2": "same", "9": "same", "3": "é" * 5000, "4": "", "5": "", None: "same", "7": "\r\n\r\nWARC/1.1\r\n"}[r.page_id].encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == {"1": ("revisit", "9"), "2": ("revisit", "9"), None: ("revisit", "9"), "4": ("revisit", "5")}.get(r.page_id, ("response", None))
        assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
    for r in got:  # a page without a url is named by its id; what a header can't hold comes back too
        assert r.url == {"1": "http://a/\r\nX: y", "2": "http://b", "9": None, "3": "http://c", "4": "http://d", "5": "http://e", None: "http://f", "7": "u"}[r.page_id]
    warc.write_index(spark, f"{tmp_path}/w", f"{tmp_path}/index")
    for r in got:  # any record by itself
        fields, payload = warc.fetch(spark, f"{tmp_path}/index", r.record_id)
        assert fields[:2] == (r.record_id, r.page_id) and payload == bytes(r.payload)
    assert warc.fetch(spark, f"{tmp_path}/index", "none") is None
    files = glob.glob(f"{tmp_path}/w/*.warc.zst")
    for f in files:  # the frames by the library; the table at the end
        data = open(f, "rb").read()
        frames = warc.read_seek_table(data)
        assert [len(zstandard.ZstdDecompressor().decompress(data[o : o + c])) for o, c, _ in frames] == [n for _, _, n in frames]
        assert zstandard.ZstdDecompressor().decompressobj().decompress(data)[:8] == b"WARC/1.1"
    refer = {r.record_id for r in got}
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in files)
    assert {x.split(b">")[0].decode() for x in whole.split(b"WARC-Refers-To: <")[1:]} <= refer
    warc.write_bundles(pages, f"{tmp_path}/least", least_bytes=5)
    assert warc.read_records(spark, f"{tmp_path}/least").where("record_type = 'revisit'").count() == 0
    warc.write_bundles(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_records(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        warc.read_seek_table(b"x" * 40)


# 6: decontamination


def brute_matches(doc, items, k=5, least=0.8):
    words, out = decontamination.words_of(doc), {}
    for item, t in items:
        w = decontamination.words_of(t)
        if not w or not words:
            continue
        kk, n = min(k, len(w)), min(len(w), len(words))
        bag = Counter(decontamination.shingles(w, k))
        if len(words) < kk:
            continue
        best = max(decontamination.weighted_similarity(bag, Counter(decontamination.shingles(words[i : i + n], kk))) for i in range(len(words) - n + 1))
        if best >= least:
            out[item] = best
    return out


def test_decontamination_is_what_brute_force_finds(spark):
    rng = random.Random(4)
    items = [(i, text(rng, rng.choice([3, 6, 15, 30, 55]))) for i in range(30)] + [(99, None), (98, ""), (97, "!!")]
    docs = [(i, text(rng, rng.randint(0, 150)), "en", "s", 0) for i in range(40)]
    for i in range(100, 160):
        w = items[i % 30][1].split()
        if i % 3 == 0 and len(w) > 20:
            w[rng.choice([0, 1, len(w) - 1])] = "changed"
        passage = " ".join(w)
        docs.append((i, f"{text(rng, 40)} {passage.upper() + '!' if i % 2 else passage} {text(rng, rng.choice([0, 30]))}", "en", "s", 0))
    d = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: dict(zip(r.item_ids, r.similarities)) for r in decontamination.matches(d, b).collect()}
    want = {i: brute_matches(t, items) for i, t, *_ in docs}
    assert {i: set(x) for i, x in got.items()} == {i: set(x) for i, x in want.items()}
    assert sum(map(len, want.values())) > 50 and not any(got[i] and not want[i] for i in got)
    for i in got:
        assert got[i] == {k: pytest.approx(v) for k, v in want[i].items()}
    in_blocks = {r.doc_id: set(r.item_ids) for r in decontamination.matches(d, b, block=7).collect()}
    assert in_blocks == {i: set(x) for i, x in got.items()}
    clean = {r.doc_id for r in decontamination.decontaminate(d, b).collect()}
    assert clean == {i for i, x in want.items() if not x}


def test_decontamination_odd(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    d = odd_documents(spark)
    out = decontamination.matches(d, b)
    assert out.count() == d.count() and out.where("size(item_ids) > 0").count() == 0
    assert decontamination.matches(empty(spark), b).count() == 0
    assert decontamination.decontaminate(d, b.limit(0)).count() == d.count()


def test_window_fingerprints_are_those_of_bags():
    rng = random.Random(6)
    words = text(rng, 60).split()
    s = decontamination.shingles(words, 5)
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in s], np.uint64)
    fp = decontamination.window_fingerprints(h, np.array([0, 7, 20]), 30)
    assert fp.tolist() == [decontamination.fingerprint(Counter(s[i : i + 30])) for i in (0, 7, 20)]


# 7: embeddings


def brute_vectors(rows, t=0.93):
    def ok(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = [0] * len(rows)
    links = []
    for i, j in combinations(range(len(rows)), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
            if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= t:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j], key=lambda k: rows[k][0])
    return sorted((rows[i][0], n[i], rows[root[i]][0]) for i in range(len(rows)))


@pytest.mark.parametrize("cell", [4096, 20, 7])
def test_near_vectors(spark, cell):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + i, (rows[0][1] if i < 3 else [1.0, float("nan")] if i == 3 else [0.0] * 16 if i == 4 else None if i == 5 else [1.0, None] if i == 6 else [2.0, 1.0] if i == 7 else rows[0][1]), None if i == 8 else rows[0][2]) for i in range(9)]
    rows += [(len(rows), [float("inf")] + [1.0] * 15, 0), (len(rows) + 1, [], 0), (len(rows) + 2, [1e200] * 16, 1), (len(rows) + 3, [1e-200] * 16, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("own")).withColumn("rep", F.lit(0)).repartition(5)
    got = metric_join.near_vectors(d, cell=cell).collect()
    want = brute_vectors([r if r[0] < len(rows) - 2 else (r[0], [1.0] * 16, r[2]) for r in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert metric_join.near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], schema)
    assert sorted((r.vec_id or 0, r.n_links) for r in metric_join.near_vectors(one).collect()) == [(0, 0), (1, 1), (1, 1)]


# 8: language


def test_language(spark):
    rng = random.Random(8)
    tongues = {"aa": ["kala", "mina", "toro", "pesu", "kivi", "lumo"], "bb": ["strunk", "glatz", "brimp", "zwerk", "klonz", "fript"]}
    rows = [(i, " ".join(rng.choice(tongues[x]) for _ in range(rng.randint(3, 80))), x if i % 9 else None, "s", 0) for i in range(400) for x in [rng.choice(["aa", "bb"])]]
    truth = {r[0]: "aa" if r[1].split()[0] in tongues["aa"] else "bb" for r in rows}
    d = spark.createDataFrame(rows, DOCS)
    c = langid.fit(d)
    assert sorted(c.samples) == ["aa", "bb"] and max(map(len, c.samples.values())) <= 250_000
    got = langid.predict(d, c).collect()
    assert len(got) == 400
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    other = langid.fit(d.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))))
    assert other.samples == c.samples  # nothing is learned from the documents held out
    mixed = spark.createDataFrame([(1, "kala strunk", "x", "s", 0)], DOCS)
    assert langid.predict(mixed, langid.Classifier(c.samples, margin=0.9)).first().rejected


def test_language_odd(spark):
    d = odd_documents(spark)
    c = langid.fit(d)
    got = langid.predict(d, c)
    assert got.count() == d.count() and {r.lang_pred for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"} and langid.predict(empty(spark), c).count() == 0


def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.predict(d, langid.fit(d)).where(langid.held_out(F.col("doc_id")))
    assert found.where("lang_pred = lang").count() >= 0.9 * found.count() > 0


# 9: lines


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, s, n, letters="abcdé"):
    y = list(s)
    for _ in range(n):
        k, i = rng.randint(0, 2), rng.randint(0, len(y))
        if k == 0:
            y.insert(i, rng.choice(letters))
        elif i < len(y):
            y[i : i + 1] = [rng.choice(letters)] if k == 1 else []
    return "".join(y)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance(spark, t):
    rng = random.Random(t)
    pairs = [(a, b) for _ in range(3000) for a in ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))] for b in [changed(rng, a, rng.randint(0, t + 2), "abé")] if 0 <= len(b) - len(a) <= t]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.banded_distance(F.col("a"), F.col("b"), t)).collect()
    assert all(min(r.d, t + 1) == min(edits(r.a, r.b), t + 1) for r in got)


def brute_lines(docs, t, least):
    norm = lambda s: " ".join(s.replace("\x0b", " ").replace("\x0c", " ").split(" ")).strip(" ")
    squeeze = lambda s: norm(__import__("re").sub(r"[\x20\x09-\x0d]+", " ", s))
    places = sorted((-1 if i is None else i, n, squeeze(x)) for i, s in docs if s is not None for n, x in enumerate(s.split("\n")))
    lines = sorted({x for *_, x in places if len(x) >= least})
    root = {x: x for x in lines}
    link = [(a, b) for a, b in combinations(lines, 2) if abs(len(a) - len(b)) <= t and edits(a, b) <= t]
    for _ in lines:
        for a, b in link:
            root[a] = root[b] = min(root[a], root[b])
    first, gone = {}, set()
    for i, n, x in places:
        if len(x) >= least and first.setdefault(root[x], (i, n)) != (i, n):
            gone.add((i, n))
    return gone


@pytest.mark.parametrize("t, least", [(1, 6), (2, 6), (2, 12)])
def test_dedup_lines(spark, t, least):
    rng = random.Random(least + t)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(3, 25))) for _ in range(25)]
    docs = [(i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(None, base[0] + "\n" + base[1]), (77, None), (78, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", F.lit("own"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d, t, least).collect()}
    gone = brute_lines(docs, t, least)
    assert {(-1 if i is None else i, n) for i, r in got.items() for n in r.removed} == gone and gone
    for i, s in docs:
        r = got[i]
        assert r.n_lines == (0 if s is None else len(s.split("\n")))
        assert r.text == (None if s is None else "\n".join(x for n, x in enumerate(s.split("\n")) if (-1 if i is None else i, n) not in gone))


def test_dedup_lines_odd(spark):
    d = odd_documents(spark)
    out = line_dedup.dedup_lines(d)
    assert out.count() == d.count() and "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    hot = spark.createDataFrame([(i, "the very same long line\nand one of its own, number %06d of many %d" % (i * 7919 % 99991, i ** 3)) for i in range(300)], "doc_id long, text string")
    assert line_dedup.dedup_lines(hot).agg(F.sum(F.array_contains("removed", 0).cast("int"))).first()[0] == 299


# 10: SimHash


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    d = odd_documents(spark)
    got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(d).collect())
    assert got == Counter((r.doc_id, brute_fingerprint(r.text)) for r in d.collect())
    rng = random.Random(1)
    long = [text(rng, 40_000), text(rng, 33_000), "", "É ÀB c d e"]
    assert simhash.fingerprints_of(long).tolist() == [brute_fingerprint(x) for x in long]
    # Spark's own hash is the same function
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("hot, blocks", [(4096, 2048), (5, 2048), (4096, 0)])
def test_hamming_links_lose_nothing(spark, hot, blocks, monkeypatch):
    rng = random.Random(hot)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    if blocks == 0:  # the masks for far more fingerprints
        masks = simhash.block_masks(1 << 40, 4)
        assert len(masks) == 70
        monkeypatch.setattr(simhash, "block_masks", lambda n, radius: masks)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.hamming_links(d, 4, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def classes(pairs):
        root = {x: x for x in fps}
        for _ in range(20):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(links) == classes([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [text(rng, 300) for _ in range(8)]
    rows = [(i, base[i % 8] if i < 24 else base[i % 8] + " end" if i < 40 else text(rng, 50), "en", "s", 0) for i in range(60)] + [(70, None, "en", "s", 0), (71, "", "en", "s", 0), (None, base[0], "en", "s", 0), (3, base[3], "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("own"))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in fp if i is not None}
    for _ in range(10):
        for i, j in combinations(list(root), 2):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[i] = root[j] = min(root[i], root[j])
    assert got == {(i, root[i]) for i in root} | {(None, 0)}
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(root.values()))
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links if None not in p and p[0] != p[1] for x in p}
    for _ in range(120):
        for a, b in links:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_match_sql(name, spark, sf, duck):
    same_rows(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_queries_cover_their_table(name, spark, sf):
    n = queries.queries()[name](spark, sf).count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count() if name != "op1_pack_tokens" else n > 0
