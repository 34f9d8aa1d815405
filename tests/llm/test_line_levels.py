"""The edit join of lines where signatures are hot, its sketches and its trimming, against brute force; and columns of any name."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from presslens.llm import decontamination, langid, line_dedup, mixing, sharding, simhash


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line))
        kind = rng.randrange(3)
        line[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdé ")]
    return "".join(line).strip()


def near_copies(rng, n, size=60):
    base = ["".join(rng.choice("abcdefgh ") for _ in range(size)).strip() for _ in range(3)]
    return list(dict.fromkeys(edited(rng, rng.choice(base), rng.randint(0, 5)) for _ in range(n)))


@pytest.mark.parametrize("levels, leaders", [(None, (4, 64)), (((1, 4), (6, 4), (14, 4)), (4, 64)), (((1, 4), (6, 4)), (1,)), (((1, 0),), ())])
def test_all_links_at_every_level(spark, monkeypatch, levels, leaders):
    if levels:
        monkeypatch.setattr(line_dedup, "LEVELS", levels)
    monkeypatch.setattr(line_dedup, "LEADERS", leaders)
    rng = random.Random(4)
    lines = [x for x in near_copies(rng, 220) if len(" ".join(x.split())) >= 16]
    lines = list(dict.fromkeys(" ".join(x.split()) for x in lines))
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("removed") == 0).collect()}
    root = {i: i for i, _ in rows}
    links = [(i, j) for (i, a), (j, b) in combinations(rows, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert got == set(root.values()) and 3 < len(got) < len(rows)


def test_sketches_and_trimming_lose_nothing(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = near_copies(rng, 1, 40)[0]
        pairs.append((a, edited(rng, a, rng.randint(0, 3))))
    pairs += [("", "ab"), ("a" * 50, "a" * 51), ("ab" * 20, "ba" * 20)]
    d = spark.createDataFrame(pairs, "a string, b string")
    one, two = line_dedup.sketches(F.col("a")), line_dedup.sketches(F.col("b"))
    cut = line_dedup.differing(F.col("a"), F.col("b"))
    d = d.select("a", "b", *[F.bit_count(x.bitwiseXOR(y)).alias(n) for x, y, n in zip(one, two, "xy", strict=True)], cut["a"].alias("ca"), cut["b"].alias("cb"))
    for r in d.collect():
        n = distance(r.a, r.b)
        assert r.x <= 2 * n and r.y <= 4 * n and distance(r.ca, r.cb) == n
        assert not (r.ca and r.cb) or (r.ca[0] != r.cb[0] and r.ca[-1] != r.cb[-1])


CLASHES = "_at _slot _s _ks _before _hash _class _cell _copy _key _row _keep _item_ids own hash class size Size k1 k2 at row line copy rank text2 id n c0 c1 found doc fp".split()


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, f"a line of some length {i % 3}\nand another one that is long", f"s{i % 2}", "en") for i in range(8)], "doc_id long, text string, source string, lang string")
    names = [c for c in CLASHES if c != "Size"]
    for c in names:
        d = d.withColumn(c, F.lit(f"mine {c}"))
    bench = spark.createDataFrame([("x", "a line of some length 1")], "item_id string, text string")
    import datetime

    dated = spark.createDataFrame([(datetime.date(2020, 1, 2), "a line of some length 1"), (None, "and another one that is long")], "item_id date, text string")
    results = {
        "shard": sharding.shard(d), "mix": mixing.mix(d), "draw": mixing.draw(d), "lines": line_dedup.dedup_lines(d), "near": simhash.drop_near_duplicates(d), "similar": simhash.drop_near_duplicates(d, similarity=0.8, k=5),
        "matches": decontamination.matches(d, bench, block=1), "dated": decontamination.matches(d, dated, block=1), "clean": decontamination.decontaminate(d, bench), "language": langid.predict(d, langid.fit(d)),
    }
    for name, out in results.items():
        rows = out.collect()
        assert rows or name == "clean", name
        for c in names:
            if not (name == "draw" and c == "size"):
                assert {r[c] for r in rows} <= {f"mine {c}"}, (name, c)
    assert {i for r in results["dated"].collect() for i in r.item_ids} == {datetime.date(2020, 1, 2), None}


def test_case_of_names(spark):
    d = spark.createDataFrame([(1, "some text", "s", 7)], "doc_id long, text string, source string, Size int")
    assert mixing.mix(d).columns == d.columns and mixing.mix(d).first().Size == 7
    drawn = mixing.draw(d)
    assert [c.lower() for c in drawn.columns].count("size") == 1 and drawn.first()["size"] == 2


def test_rows_without_an_id_spread_over_cells(spark):
    d = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows, _ = mixing.set_aside(d)
    placed = mixing._drawn(d, rows, (5, 2, 1), 3.0, "0", 200, "doc_id", "text", "source")
    cells = [r["count"] for r in placed.groupBy("class", "cell").count().collect()]
    assert len(cells) > 10 and max(cells) < 450


def test_numerals_are_no_letters():
    c = langid.Classifier({"en": b" the of and to ", "de": b" der die und zu "})
    assert c.predict("½ ² ①")[0] == "und" and c.predict("a")[0] in ("en", "de")


def test_classifier_against_plain_compression(spark, sf):
    """Label, score and rejection by compressing each piece with each dictionary anew."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = langid.fit(docs)

    def size(sample, raw):
        made = zstandard.ZstdCompressor(level=c.level, dict_data=zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(made.compress(raw))

    for r in langid.predict(docs, c).collect()[:60]:
        if not any(x.isalpha() for x in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        raw, found = langid.normal(r.text), []
        for n, (language, s) in enumerate(c.samples.items()):
            total = sum(size(s, raw[i : i + c.piece]) for i in range(0, len(raw), c.piece))
            if len(raw) < langid.SHORT:
                total += sum(size(s[len(s) * k // langid.PARTS : len(s) * (k + 1) // langid.PARTS], raw) for k in range(langid.PARTS))
            found.append((total, n, language))
        best, second = sorted(found)[:2]
        gap = (second[0] - best[0]) / second[0]
        assert r.lang_pred == best[2] and abs(r.score - min(1.0, 4 * gap)) < 1e-12 and r.rejected == (gap < c.margin)
