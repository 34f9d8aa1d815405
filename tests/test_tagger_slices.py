"""The tagger compares names by bits, remembers them, and gives texts back in slices."""

import random
import time

from presslens.plans import mentions


def plain(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randrange(90)))
    for _ in range(2000):
        a, b = word(), word()
        assert mentions.sort_ratio(a, b) == plain(a, b)


def test_nearest():
    names = {n: f"<{n}>" for n in ("ann lee smith", "ann lea smith", "bob", "rob jones")}
    for order in (names, dict(reversed(names.items()))):
        t = mentions.Tagger(order, {}, fuzzy=85.0)
        assert t("Ann Le Smith and Rob Jonees met Bob.") == "<ann lea smith> and <rob jones> met Bob."


def test_many_texts_take_little_time():
    names = {f"{a} {b}son{c}": "<x>" for a in ("ann", "robert", "theresa") for b in ("john", "peter") for c in "abcdefghijklmnopqrst"}
    t = mentions.Tagger(names, {}, fuzzy=85.0)
    began = time.process_time()
    for _ in range(3000):
        t("We saw Roberta Johnsonx. She was Theresa Petersony. Somebody met Anne Nobodyson.")
    assert time.process_time() - began < 10


def test_slices(spark, monkeypatch):
    texts = ["Ann Lee spoke.", None, "x" * 1_200_000, "", "ann lee"] * 500
    df = spark.createDataFrame([(i, t if i < 10 or len(t or "") < 100 else "y", [i]) for i, t in enumerate(texts)], "id int, `te xt` string, more array<int>").coalesce(1)
    names, gated = spark.createDataFrame([("ann lee", "<ann_lee>")], "alias string, tag string"), spark.createDataFrame([], "word string, tag string")
    got = mentions.tag(df, names, gated, text="te xt", mode="all").collect()
    want = {"Ann Lee spoke.": "<ann_lee> spoke.", "ann lee": "<ann_lee>", None: ""}
    assert [r.id for r in got] == list(range(len(texts)))
    assert all(r.tagged_text == want.get(r["te xt"], r["te xt"]) and r.more == [r.id] and r.tag_error is None for r in got)
