"""Quirks and properties that the tables don't show."""

import pytest
from pyspark.sql import functions as F

from presslens import schema
from presslens.functions import html as H
from presslens.functions import text as T
from presslens.functions import values as V
from presslens.operators import aggregates as A
from presslens.operators import dedupe as D
from presslens.operators import filters as L
from presslens.operators import joins as J
from presslens.operators import sampling as S
from presslens.plans import annotate, causal, corpus, corpus_views, frames, gazetteer, mentions, personas
from presslens.sources import files, web


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three", ["One.", "Two!", "Three"]),
    ("a line\n\n  and more. Next", ["a line and more.", "Next"]),
    ("The U.K. Government said. “Yes.” No", ["The U.K.", "Government said.", "“Yes.” No"]),
    ("no. capital follows", ["no. capital follows"]),
    ("1. 2. 0", ["1. 2. 0"]),
    ("", []), (None, []), ("   ", []),
])
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_names(spark):
    assert one(spark, T.normal_name, "The Rt. Hon. Lord X") is not None
    assert one(spark, T.first_last, "David William Donald Cameron") == "David Cameron"
    assert one(spark, T.first_last, "Jacob Rees-Mogg") == "Jacob Rees-Mogg"
    assert one(spark, T.tag_of, "Jacob Rees-Mogg") == "<jacob_rees_mogg>"
    assert one(spark, T.persona_name, "The Old Man,") == "old man"
    assert one(spark, T.pronoun, "HIM") == "he" and one(spark, T.pronoun, "cat") is None
    assert one(spark, T.nominalisation, "resignation") and not one(spark, T.nominalisation, "cat")
    assert T.flexible_pattern(["May", "Theresa May"]) == r"Theresa\s+May|May"


def test_values(spark):
    assert one(spark, V.list_of, " a; ;b;") == ["a", "b"]
    assert one(spark, V.number, "x") is None and one(spark, V.number, "5") == 5.0
    assert one(spark, V.stamp, "20200102030405").year == 2020
    assert one(spark, lambda c: V.share(F.lit(1), F.lit(0)), "x") == 0.0


def test_html(spark):
    got = lambda h: tuple(one(spark, lambda c: H.published(c), h) or (None, None))
    assert got('<script type="application/ld+json">{"@graph": [{"dateCreated": "2001"}]}</script><time>then</time>')[0] == "2001"
    assert got('<meta content="2002" name="DC.date.issued">') == ("2002", "meta:name:DC.date.issued")
    assert got("<time>May <b>3</b></time>") == ("May 3", "time:text")
    assert got(None) == (None, None)
    assert one(spark, H.main_text, f"<article>{'x' * 200}</article>") is None
    assert one(spark, H.main_text, f"<article>{'x' * 201}</article>") == "x" * 201
    assert one(spark, H.to_text, "<p>a&amp;lt;<script>b</script><!-- c --> d</p>") == "a&lt; d"


def test_filters(spark):
    d = spark.createDataFrame([("Opinion ",), ("news",), (None,)], "s string")
    assert d.where(L.among(F.col("s"), ["opinion"])).count() == 1
    assert d.where(L.filled(F.col("s"))).count() == 2
    assert len(L.AMBIGUOUS_SURNAMES) == len(set(L.AMBIGUOUS_SURNAMES))
    y = spark.createDataFrame([("1989-12-31",), ("1990-01-01",), ("2024-12-31",), ("2025-01-01",), ("junk",), (None,)], "d string")
    assert [r.d for r in y.where(L.year_between(F.col("d"), 1990, 2024)).collect()] == ["1990-01-01", "2024-12-31"]
    t = spark.createDataFrame([("Vote vote VOTERS",), ("vote office politics",), (None,)], "t string")
    assert [r[0] for r in t.select(L.relevance(F.col("t"), L.POLITICAL_TERMS, L.NOT_POLITICAL)).collect()] == [3, 0, 0]


def test_corpus_filters_before_dedupe(spark):
    api = spark.createDataFrame([(1, "news", "1980-01-01", "u", "early"), (2, "news", "2000-01-01", "u", "right"), (3, "NEWS ", "2000-01-01", "u", "later"), (4, "news", "2000-01-01", None, "x" * 250), (5, "news", "2000-01-01", None, "x" * 300), (6, "news", "2000-01-01", None, " ")], "seq int, sectionName string, webPublicationDate string, webUrl string, bodyContent string")
    db = spark.createDataFrame([(1, "news", "2001-01-01", "u", "copy"), (2, "news", "2001-01-01", "v", "other")], "seq int, `Article Category` string, `Publication Date` string, URL string, `Article Contents` string")
    out = corpus.build({"api": api, "db": db}, {"api": "seq", "db": "seq"}, ["news"])
    assert sorted(r.content[:5] for r in out.collect()) == ["other", "right", "xxxxx"]
    assert set(out.columns) == {*schema.ARTICLE, "load_seq", "published_at"}


def test_best_record_ties(spark):
    rows = [("u#a", "x", "long text", "2001", 1), ("u#b", "5", "t", "2000", 2), ("u", None, "t", "2003", 3), ("w", "5", "aa", None, 4), ("w", "5", "bb", None, 5)]
    d = spark.createDataFrame(rows, "url string, quality string, content string, date string, seq int")
    assert sorted(r.seq for r in corpus.merge_best([d]).collect()) == [2, 4]
    assert corpus.merge_best([d], fragment=False).count() == 4


def test_dedupe_is_idempotent_and_nulls(spark):
    rows = [("P", "a b  c", 1), ("P", "a b c", 2), ("P", "xx a b c yy", 3), ("P", "", 4), ("Q", "a b c", 5), (None, "zz", 6), ("P", "XX A B C", 7)]
    d = spark.createDataFrame(rows, "person string, snippet string, seq int")
    out = D.dedupe_snippets(d, "person", "snippet", "seq")
    assert sorted(r.seq for r in out.collect()) == [3, 4, 5]
    assert sorted(r.seq for r in D.dedupe_snippets(out, "person", "snippet", "seq").collect()) == [3, 4, 5]


@pytest.mark.parametrize("most", [1, 2, 3, 100])
def test_cap(spark, most):
    d = spark.range(20).select(F.col("id"), F.when(F.col("id") < 10, "a").when(F.col("id") < 13, "b").alias("g"))
    out = {r.g: r.n for r in S.cap(d, ["g"], "id", most).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert out == {"a": min(10, most), "b": min(3, most), None: min(7, most)}


def test_cap_sweep_and_shares(spark):
    d = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "p string, n long")
    r = A.cap_sweep(d, "n", [3, 100], k=2).orderBy("cap").collect()
    assert [(x.kept, x.kept_pct, x.top_pct, x.capped) for x in r] == [(7, 46.7, 85.7, 2), (15, 100.0, 93.3, 0)]
    t = A.top_share(d, "n", 1, ["p"]).first()
    assert (t.top, t.total) == (10, 15)


def test_agreement_with_an_empty_class(spark):
    r = A.agreement(spark.createDataFrame([(0, 0), (0, 0)], "a int, b int"), "a", "b").first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.kappa) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_resamples(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    r = S.resamples(docs.unionByName(docs), 3).collect()
    assert sorted(map(tuple, r)) == sorted(map(tuple, S.resamples(docs, 3).collect())) and len({(x.b, x.doc_id) for x in r}) == len(r)
    for b in range(3):  # about as many draws as documents, a share of exp(-1) never drawn
        t = [x.t for x in r if x.b == b]
        assert abs(sum(t) - 4000) < 320 and abs(len(t) / 4000 - 0.632) < 0.04 and 3 <= max(t) <= 9
    assert S.resamples(docs, 0).count() == 0


NAMES = {"theresa may": "<theresa_may>", "carolyn harris": "<carolyn_harris>", "ann harris": "<ann_harris>"}
GATED = {"may": {"<theresa_may>"}, "theresa": {"<theresa_may>"}, "harris": {"<carolyn_harris>", "<ann_harris>"}, "carolyn": {"<carolyn_harris>"}, "ann": {"<ann_harris>"}}


@pytest.mark.parametrize("text, want", [
    ("Theresa May spoke. Then May left in may.", "<theresa_may> spoke. Then <theresa_may> left in may."),
    ("May spoke.", "May spoke."),
    ("Carolyn Harris came. Harris left.", "<carolyn_harris> came. <carolyn_harris> left."),
    ("Carolyn Harris and Ann Harris came. Harris left.", "<carolyn_harris> and <ann_harris> came. Harris left."),
    ("THERESA MAY", "<theresa_may>"), (None, ""), ("  ", ""),
])
def test_tagger_gates_single_words(text, want):
    assert mentions.Tagger(NAMES, GATED)(text) == want


def test_tagger_modes():
    assert mentions.Tagger(NAMES | {"may": "<theresa_may>"}, {}, gate="none")("In may.") == "In <theresa_may>."
    assert mentions.Tagger(NAMES, {}, fuzzy=85.0)("We saw Teresa May.") == "We saw <theresa_may>."
    assert mentions.Tagger(NAMES, {}, fuzzy=85.0)("We saw Somebody Else.") == "We saw Somebody Else."
    assert mentions.resolve_pronouns("Ann ran. She won.", [[(0, 3), (9, 12)]]) == "Ann ran. Ann won."


def test_tag_then_extract(spark):
    g = spark.createDataFrame([("Theresa May", "F"), ("Ed Balls", " ")], "name_final string, gender string")
    rows = gazetteer.aliases(g)
    d = spark.createDataFrame([(1, "Theresa May met Ed Balls. Theresa May left."), (2, None)], "id int, content string")
    t = mentions.tag(d, gazetteer.name_table(rows), gazetteer.gated_words(rows))
    assert t.where("tag_error IS NOT NULL").count() == 0
    out = mentions.extract(t, g, keep=["id"]).orderBy("sent_id", "mp").collect()
    assert [(r.sent_id, r.mp, r.gender) for r in out] == [(0, "Ed Balls", None), (0, "Theresa May", "F"), (0, "Theresa May", "F")]  # a tag isn't a capital: no new sentence
    assert mentions.extract(t, g, keep=["id"], distinct=True).count() == 2


def test_gazetteer_alias_rules(spark):
    g = spark.createDataFrame([("Theresa May",), ("Carolyn Jane Harris",), ("",), (None,)], "name_final string")
    a = {(r.alias, r.tag) for r in gazetteer.aliases(g).collect()}
    assert ("May", "<theresa_may>") not in a  # a month
    assert ("Carolyn Harris", "<carolyn_jane_harris>") in a and ("Harris", "<carolyn_jane_harris>") in a


def test_moral_scores_without_moral_words(spark):
    d = spark.createDataFrame([(1, "kind kind cruel x"), (2, "x y"), (3, None)], "id int, t string")
    s = frames.moral_scores(d, "id", "t", spark.createDataFrame([("kind", "care.virtue"), ("cruel", "care.vice")], "word string, category string"))
    r = {x.id: x for x in s.collect()}
    assert r[1].valence == pytest.approx(1 / 3) and r[1].moral_ratio == pytest.approx(3, rel=1e-6)
    assert (r[2].valence, r[3].valence) == (0.0, 0.0)


def test_passive(spark):
    d = spark.createDataFrame([("The painting has been drawn.",), ("It was quickly painted by her and is seen.",), ("She paints.",), (None,)], "t string")
    r = [(x.passives, x.full, x.truncated) for x in frames.passive_flags(d, "t").collect()]
    assert r == [(1, False, True), (2, True, True), (0, False, False), (0, False, False)]


def test_persona_scores_of_a_story(spark):
    """Sums 3 for one person and 1 for the other, over their mentions."""
    lex = spark.createDataFrame([("abandon", 1.0, -1.0), ("absorb", 1.0, -1.0), ("address", 1.0, -1.0), ("accompany", -1.0, 1.0)], "verb string, agent double, theme double")
    args = spark.createDataFrame([(0, "brian", "nsubj", "abandon", 1), (0, "brian", "nsubj", "absorb", 1), (0, "brian", "nsubj", "address", 1), (0, "i", "nsubj", "accompany", 1), (0, "brian", "dobj", "accompany", 1), (0, "brian", "nsubj", "unknown", 2)], "doc_id int, persona string, role string, verb string, cnt int")
    s = personas.PersonaScorer(args, lex)
    assert {r.persona: round(r.score, 6) for r in s.totals().collect()} == {"brian": round(4 / 6, 6), "i": -1.0}
    assert {r.persona: r.scored_verbs for r in s.by_document().collect()} == {"brian": 4, "i": 1}
    assert s.totals(2).count() == 1 and s.top_personas(-1).first().persona == "i"
    assert s.documents_with_persona("BRIAN").count() == 1 and s.matched_pairs().count() == 5
    b = {r.persona: r for r in s.bootstrap(5).collect()}
    assert b["i"].score == -1.0 and b["i"].sd == 0.0


def test_labels_of_the_lexicon(spark):
    t = spark.createDataFrame([("v", None, None)], "verb string, power string, agency string")
    assert personas.label_lexicon(t, "power").count() == 0
    with pytest.raises(ValueError):
        personas.lexicon(t, "verb", "nothing", "agency")


def test_causal_hold_needs_responsible(spark, sf):
    from presslens.queries.annotated import causal_edges_of

    e = causal_edges_of(spark, sf).collect()
    assert {x.article_index % 11 for x in e} == {0, 1, 3, 5, 6, 8, 10}
    assert causal.aggregate(spark.createDataFrame([], "article_index int, person string, confidence double")).count() == 0


def test_causal_over_the_annotator(spark):
    d = spark.createDataFrame([(1, "The Cuts triggered a backlash.")], "doc_id long, text string")
    a = annotate.annotate(d)
    spans = causal.candidates(a["ann_token"], a["ann_entity"], a["ann_chunk"])
    owners = d.select("doc_id", F.lit("p").alias("person"), F.lit(0).alias("article_index"), F.lit(1).alias("snippet_index"))
    assert [(x.relation, x.cause, x.effect) for x in causal.edges(a["ann_token"], spans, owners).collect()] == [("CAUSED", "The Cuts", "a backlash")]


def test_anchor_prefers_the_longest_variant(spark):
    d = spark.createDataFrame([(1, "Then Boris Johnson spoke."), (2, "Nobody spoke.")], "doc_id long, text string")
    v = spark.createDataFrame([(1, "Johnson"), (1, "Boris Johnson"), (2, "Johnson")], "doc_id long, variant string")
    assert sorted((r.doc_id, r.start, r.end, r.text) for r in causal.anchors(annotate.tokens(d), v).collect()) == [(1, 1, 3, "Boris Johnson"), (2, -1, -1, "Johnson")]


def test_joins(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 5, 6)], "doc_id long, start int, end int")
    other = spark.createDataFrame([(1, 2, 4)], "doc_id long, start int, end int")
    assert [r.start for r in J.without_overlap(spans, other).collect()] == [5]
    assert J.without_overlap(spans, other, touching=False).count() == 2
    words = spark.createDataFrame([(1, "harris"), (1, "may")], "doc_id long, word string")
    cand = spark.createDataFrame([("harris", "<a>"), ("harris", "<b>"), ("may", "<c>")], "word string, tag string")
    found = spark.createDataFrame([(1, "<a>"), (1, "<b>"), (1, "<c>")], "doc_id long, tag string")
    assert [r.tag for r in J.unique_candidates(words, cand, found).collect()] == ["<c>"]
    toks = spark.createDataFrame([(1, 3)], "doc_id long, tok_i int")
    ss = spark.createDataFrame([(1, 0, 9, "a", "NP", 1), (1, 2, 4, "b", "PERSON", 3), (1, 3, 5, "c", "NP", 4)], "doc_id long, start int, end int, text string, label string, head_i int")
    assert J.smallest_span(toks, ss).first().text == "c"


def test_topics(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [99.0, 0.0])], "id int, v array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.1]), (1, [5.0, 5.1])], "topic_id int, c array<double>")
    assert {r.id: r.topic_id for r in corpus_views.nearest_topic(d, c, "id", "v", 1.0).collect()} == {1: 0, 2: 1, 3: -1}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a b.csv").write_text('x,y\n1,"two\nlines ""q"""\n')
    (tmp_path / "in/c.csv").write_text("x,y\n3,z\n")
    t = files.read_topics(spark, f"file://{tmp_path}/in").orderBy("x").collect()
    assert t[0].y == 'two\nlines "q"' and t[1].topic == "c"
    assert files.read_parts(spark, [f"{tmp_path}/in/c.csv", f"{tmp_path}/in/none.csv"]).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_parts(spark, [f"{tmp_path}/none.csv"])
    (tmp_path / "l.jsonl").write_text('{"a": {"b": 1}}\n\nbroken\n{"a": {"b": 2}}\n')
    j = files.read_json_lines(spark, f"{tmp_path}/l.jsonl", "a struct<b:int>")
    assert sorted(r["a.b"] for r in schema.flatten(j).collect()) == [1, 2]
    (tmp_path / "n.txt").write_text("one\ntwo\n\nthree\n")
    assert [r.text for r in files.read_paragraphs(spark, f"{tmp_path}/n.txt").collect()] == ["one two", "three"]
    assert files.read_lines(spark, f"{tmp_path}/n.txt").count() == 3
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert files.read_tsv(spark, f"{tmp_path}/t.tsv").first().b == "2"
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, f"{tmp_path}/r.json").count() == 2
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.csv", "x,y\n1,2\n")
    assert files.read_zip_member(spark, f"{tmp_path}/z.zip", "m.csv", "x string, y string").where("x = '1'").count() == 1
    d = spark.createDataFrame([("a/b", 1), ("c", 2)], "topic string, n int")
    files.write_topics(d, f"{tmp_path}/topics")
    assert spark.read.parquet(f"{tmp_path}/topics").count() == 2
    files.write_csv(d, f"{tmp_path}/csv", one_file=True, quote_all=True)
    assert files.read_csv(spark, f"{tmp_path}/csv").count() == 2
    files.append_json(d, f"{tmp_path}/json")
    files.append_json(d, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 4
    files.write_by_suffix(d, f"{tmp_path}/x.json")
    files.write_people(d.withColumnRenamed("topic", "person"), f"{tmp_path}/people")
    files.save_relations({"d": d}, f"{tmp_path}/run")
    assert files.load_relations(spark, f"{tmp_path}/run", ["d"])["d"].count() == 2


def test_web_relations(spark):
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>",)], "xml string")
    maps = spark.createDataFrame([("s1", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>")], "url string, xml string")
    assert sorted(r.location for r in web.crawl_order(index, maps).collect()) == ["p1", "p2"]
    body = '﻿{"Members": {"Member": {"@Member_Id": "5", "StartDate": {"#text": "2001-02-03T00:00"}, "EndDate": "2004-01-01"}}}'
    r = web.bulk_memberships(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.id, r.start, r.end) == (5, "2001-02-03", "2004-01-01")


def test_schema_helpers(spark):
    d = spark.createDataFrame([(1, "x")], "id int, ` BodyContent ` string")
    low = schema.lower_names(d)
    assert schema.text_column(low) == "bodycontent" and schema.has(low, "id")
    assert schema.align(low, ["id", "zzz"]).columns == ["id", "zzz"]
    with pytest.raises(ValueError):
        schema.require(low, "nothing")
    with pytest.raises(ValueError):
        schema.text_column(low.select("id"))


def test_stream_appends_once(spark, tmp_path):
    from presslens.streaming import streams

    src, out, cp = (f"{tmp_path}/{x}" for x in ("src", "out", "cp"))
    spark.range(3).write.parquet(src)
    run = lambda: streams.append(streams.read_stream(spark, src, "id long", 1), out, cp).awaitTermination()
    run()
    spark.range(3, 5).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_named_gender_against_plain_python(spark, sf):
    import re
    from collections import Counter

    from presslens.plans import annotate, corpus_views

    own = ["The Orre met The Orre, and Of Orre met Orre Orre", "Orre Lund saw Of Lund and The Berg", "Lund Orre. The Lund, Of Lund", None]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    guesses = {"the": "male", "of": "mostly_female", "orre": "female"}
    n = Counter()
    for r in docs.collect():
        seen = set()
        for m in re.finditer(r"([A-Z\u00C0-\u00DE][^\W\d_'’-]?(?:[^\W\d_]|['’-])+(?:\s+[A-Z\u00C0-\u00DE](?:[^\W\d_]|['’-])+)+)", r.text or ""):
            words = m[0].split()
            if m[0].strip() not in seen and words[1] not in seen:
                seen |= {m[0].strip(), words[1]}
                guess = guesses.get(words[0].lower(), "")
                n["male" if guess.endswith("male") and "female" not in guess else "female" if "female" in guess else "unknown"] += 1
    first = spark.createDataFrame([(a.title(), b) for a, b in guesses.items()], "first string, gender string")
    got = {r.gender: r.n for r in corpus_views.named_gender(annotate.people(docs), first).collect()}
    assert got == dict(n) and set(got) == {"male", "female", "unknown"}


def test_missing_pages_are_told(spark):
    from presslens.sources import web

    page = '{"items": [{"value": {"id": 7}}], "totalResults": 2}'
    with pytest.raises(ValueError, match="1 of 2"):
        web.complete_pages(spark.createDataFrame([(page,)], "body string"))


def test_entities(spark):
    from presslens.functions.html import unescape

    d = spark.createDataFrame([("&lt;a&gt; &amp;lt; &eacute;&#233;&#xE9; &#8364;&euro; &nosuch; &#0; &#xD800; &#128512; A&nbsp;B & C",), ("none",), (None,)], "s string")
    assert [r[0] for r in d.select(unescape(F.col("s"))).collect()] == ["<a> &lt; ééé €€ &nosuch; &#0; &#xD800; 😀 A B & C", "none", None]


def test_tag_command(spark, tmp_path):
    from presslens import tag
    from presslens.sources import files

    (tmp_path / "people.csv").write_text("Name,Aliases\nTheresa May,\nBoris Johnson,BoJo; \n")
    (tmp_path / "in.tsv").write_text("URL\tContent\nu1\tTheresa May spoke. May left.\nu2\tnobody\n")
    tag.main(["--people", f"{tmp_path}/people.csv", "--articles", f"{tmp_path}/in.tsv", "--output", f"{tmp_path}/out.json"], spark)
    got = {r.url: r.tagged_text for r in spark.read.json(f"{tmp_path}/out.json").collect()}
    assert got == {"u1": "<theresa_may> spoke. <theresa_may> left.", "u2": "nobody"}
    (tmp_path / "topics").mkdir()
    (tmp_path / "topics" / "a b.csv").write_text('text\n"Boris Johnson, twice\nBoris Johnson"\n')
    (tmp_path / "topics" / "c.csv").write_text("text\nnone\n")
    tag.main(["--people", f"{tmp_path}/people.csv", "--topic-dir", f"{tmp_path}/topics", "--output-dir", f"{tmp_path}/tagged", "--mode", "all"], spark)
    got = {r.topic: r.tagged_text for r in files.read_topics(spark, f"{tmp_path}/tagged").collect()}
    assert got == {"a_b": "<boris_johnson>, twice\n<boris_johnson>", "c": "none"}
    with pytest.raises(SystemExit):
        tag.main(["--people", "x"], spark)


def test_density_clusters(spark):
    import random

    from presslens.operators.density import density_clusters
    from presslens.plans import corpus_views

    rng = random.Random(3)
    rows = [(i, [rng.gauss(c, 0.3), rng.gauss(-c, 0.3), rng.gauss(0, 0.3)]) for i, c in enumerate([0] * 40 + [5] * 30)] + [(90, [50.0, 0.0, 0.0]), (91, None), (92, [1.0]), (93, [float("nan")] * 3)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    near = {i: [j for j, w in rows if w and len(w) == 3 and sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5 <= 0.5] for i, v in rows if v and len(v) == 3}
    core = {i for i, x in near.items() if len(x) >= 5}
    root = {i: i for i in core}
    for _ in rows:
        for i in core:
            root[i] = min(root[j] for j in near[i] if j in core)
    want = {i: root[i] if i in core else min((root[j] for j in near.get(i, []) if j in core), default=None) for i, _ in rows}
    assert {r.id: r.cluster for r in density_clusters(d, "id", "v", 3, 0.5, 5).collect()} == want and len(set(want.values())) >= 3
    t = {r.id: r.topic_id for r in corpus_views.density_topics(d.where("id < 91"), "id", "v", 0.7, 5, 2).collect()}
    assert t[90] == -1 and set(t.values()) >= {-1, 0, 1}
