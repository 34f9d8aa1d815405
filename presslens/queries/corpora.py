"""Corpus, filter, dedupe, set, sort and top-k queries."""

from pyspark.sql import functions as F

from presslens import schema
from presslens.functions import text as T
from presslens.functions import values as V
from presslens.operators import aggregates as A
from presslens.operators import dedupe as D
from presslens.operators import filters as L
from presslens.operators import joins as J
from presslens.operators import sampling as S
from presslens.plans import corpus, corpus_views
from presslens.queries import constant, named, query, spread, spread_sql, table
from presslens.queries.texts import sentences_sql

SECTIONS = ["SRC1", " src2 ", "src3", "src4", "src5", "src6", "fr", "en", "de"]


def _api(spark, d):
    """documents in the shape of one source: no url for one language, urls that repeat for the others, dates from 1985 on, some of them no date."""
    x = table(spark, d, "documents")
    url = F.when(F.col("lang") == "es", None).otherwise(F.concat(F.lit("https://a/"), F.col("n_chars").cast("string")))
    date = F.when(F.length("source") == 4, F.lit("soon")).otherwise(F.date_add(F.lit("1985-01-01").cast("date"), (F.pmod(F.col("doc_id") * 37, F.lit(15000))).cast("int")).cast("string"))
    return x.select("doc_id", F.concat(F.lit(" "), F.upper("source")).alias("sectionName"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("webTitle"), url.alias("webUrl"), F.col("text").alias("bodyContent"), date.alias("webPublicationDate"))


def _db(spark, d):
    x = table(spark, d, "pages")
    lang = F.regexp_extract("url", r"/(en|fr|de|es)/", 1)
    return x.select("page_id", F.col("url").alias("URL"), lang.alias("Article Category"), F.lit("2001-02-03").alias("Publication Date"), F.lit(None).cast("string").alias("Article Author"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("Article Title"), F.col("html").alias("Article Contents"))


ARTICLES_SQL = """
    api AS (SELECT CASE WHEN lang = 'es' THEN NULL ELSE 'https://a/' || n_chars END AS url, ' ' || upper(source) AS section, CASE WHEN length(source) = 4 THEN 'soon' ELSE CAST(CAST(DATE '1985-01-01' + CAST(doc_id * 37 % 15000 AS INTEGER) AS DATE) AS VARCHAR) END AS date,
                   't' || doc_id AS title, text AS content, CAST(NULL AS VARCHAR) AS author, 'api' AS source, 0 AS part, doc_id AS row FROM documents),
    db AS (SELECT url, regexp_extract(url, '/(en|fr|de|es)/', 1) AS section, '2001-02-03' AS date, 'p' || page_id AS title, html AS content, CAST(NULL AS VARCHAR) AS author, 'db' AS source, 1 AS part, page_id AS row FROM pages),
    both_sources AS (SELECT * FROM api UNION ALL SELECT * FROM db)"""
FILTERED_SQL = f"""{ARTICLES_SQL},
    kept AS (SELECT *, try_cast(date AS TIMESTAMP) AS published_at FROM both_sources WHERE lower(trim(section)) IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'fr', 'en', 'de') AND year(try_cast(date AS TIMESTAMP)) BETWEEN 1990 AND 2024 AND length(trim(content)) > 0)"""
BUILD_SQL = f"""
    WITH {FILTERED_SQL},
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, row) AS r FROM kept WHERE url IS NOT NULL) WHERE r = 1
              UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY substring(trim(content), 1, 200) ORDER BY part, row) AS r FROM kept WHERE url IS NULL) WHERE r = 1)
    SELECT title, url, section, date, source, CAST(length(content) AS BIGINT) AS chars, CAST(year(published_at) AS BIGINT) AS year FROM first"""


@query("corpus_build", BUILD_SQL)
def corpus_build(spark, d):
    """DOM01 with SRC05, PRJ01, PRJ03, PRJ04, SET01, FLT01, FLT03, FLT05, WIN01, WIN02."""
    out = corpus.build({"api": _api(spark, d), "db": _db(spark, d)}, {"api": "doc_id", "db": "page_id"}, SECTIONS)
    return out.select("title", "url", "section", "date", "source", F.length("content").cast("bigint").alias("chars"), F.year("published_at").cast("bigint").alias("year"))


@query("set01_union_align", f"WITH {ARTICLES_SQL} SELECT title, url, section, date, author, source, part * 1000000000 + row AS seq FROM both_sources")
def union_align(spark, d):
    x = corpus.combine({"api": _api(spark, d), "db": _db(spark, d)}, {"api": "doc_id", "db": "page_id"})
    return x.select("title", "url", "section", "date", "author", "source", (F.col("load_seq.part") * 1000000000 + F.col("load_seq.row")).alias("seq"))


@query("set03_counts_before_after", f"WITH {FILTERED_SQL} SELECT count(*) AS n, count(DISTINCT url) AS urls, (SELECT count(*) FROM both_sources) AS n_before FROM kept")
def counts(spark, d):
    x = corpus.combine({"api": _api(spark, d), "db": _db(spark, d)}, {"api": "doc_id", "db": "page_id"})
    kept = x.where(L.among(F.col("section"), SECTIONS) & L.year_between(F.col("date"), 1990, 2024) & L.filled(F.col("content")))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls")).crossJoin(x.agg(F.count(F.lit(1)).alias("n_before")))


@query("dom_merge_best", """
    SELECT doc_key, doc_id FROM (SELECT 'k' || n_chars AS doc_key, doc_id, row_number() OVER (PARTITION BY n_chars ORDER BY try_cast(CASE WHEN lang = 'de' THEN 'x' ELSE source[4:] END AS DOUBLE) DESC NULLS LAST, length(text) DESC, lang DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r = 1""")
def merge_best(spark, d):
    """WIN03, SRT02, TXT15, MTH06: the best record of each url without its fragment."""
    x = table(spark, d, "documents").select(F.concat(F.lit("k"), F.col("n_chars").cast("string"), F.lit("#"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("lang") == "de", "x").otherwise(F.substring("source", 4, 9)).alias("quality"), F.col("text").alias("content"), F.col("lang").alias("date"), F.col("doc_id").alias("seq"), "doc_id")
    return corpus.merge_best([x]).select(F.col("url").alias("doc_key"), "doc_id")


@query("agg08_null_profile", """
    WITH x AS (SELECT text, nullif(lang, 'es') AS lang, source FROM documents), n AS (SELECT count(*) AS n FROM x)
    SELECT 'text' AS "column", count(*) FILTER (WHERE text IS NULL) AS nulls, round(100.0 * count(*) FILTER (WHERE text IS NULL) / count(*), 6) AS percent FROM x
    UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), round(100.0 * count(*) FILTER (WHERE lang IS NULL) / count(*), 6) FROM x
    UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL), round(100.0 * count(*) FILTER (WHERE source IS NULL) / count(*), 6) FROM x""")
def null_profile(spark, d):
    return A.null_profile(table(spark, d, "documents").select("text", F.nullif("lang", F.lit("es")).alias("lang"), "source"))


@query("agg07_count_by_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1")
def by_year(spark, d):
    return A.group_count(table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("bigint")), ["year"])


@query("agg09_global_stats", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus IS NULL) AS nulls, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def global_stats(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus").isNull()).alias("nulls"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("agg10_length_stats", "SELECT round(avg(length(text)), 6) AS mean, CAST(median(length(text)) AS DOUBLE) AS median FROM documents")
def length_stats(spark, d):
    return table(spark, d, "documents").agg(F.round(F.avg(F.length("text")), 6).alias("mean"), F.median(F.length("text")).alias("median"))


@query("agg06_top_sources", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, d):
    return A.top_groups(table(spark, d, "documents"), ["source"], 10)


@query("win01_first_by_url", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR lang = 'es' AND r = 1")
def first_by_url(spark, d):
    return D.keep_first(table(spark, d, "documents"), ["n_chars"], [F.col("doc_id")]).select("doc_id")


@query("win01_null_keys_stay", "SELECT doc_id FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE n_chars END AS k FROM documents)) WHERE r = 1 OR k IS NULL")
def null_keys_stay(spark, d):
    key = F.when(F.col("lang") != "es", F.col("n_chars"))
    return D.keep_first_or_null(table(spark, d, "documents"), key, [F.col("doc_id")]).select("doc_id")


@query("win02_first_by_prefix", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substring(trim(text), 1, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_by_prefix(spark, d):
    return D.keep_first(table(spark, d, "documents"), [F.substring(F.trim("text"), 1, 200)], [F.col("doc_id")]).select("doc_id")


@query("win05_exact_snippets", r"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, trim(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\s+', ' ', 'g')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_snippets(spark, d):
    return D.exact_snippets(table(spark, d, "documents"), "source", "text", "doc_id").select("doc_id")


@query("jon16_drop_contained", """
    SELECT DISTINCT a.p_brand, a.p_name FROM part a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand, p_name || ' of ' || p_type AS big FROM part WHERE p_size > 25 UNION SELECT DISTINCT p_brand, p_name FROM part) b WHERE a.p_brand = b.p_brand AND length(b.big) > length(a.p_name) AND contains(lower(b.big), lower(a.p_name)))""")
def contained(spark, d):
    """DOM12: exact, then containment, within a person."""
    p = table(spark, d, "part")
    both = p.select("p_brand", "p_name", F.lit(1).alias("own")).unionByName(p.where("p_size > 25").select("p_brand", F.concat_ws(" of ", "p_name", "p_type").alias("p_name"), F.lit(0).alias("own")))
    both = both.distinct()
    return D.drop_contained(both, "p_brand", "p_name", "own").where("own = 1").select("p_brand", "p_name").distinct()


@query("agg28_dedupe_counts", f"""
    WITH {sentences_sql()}, s AS (SELECT lang AS topic, source AS person, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) AS snippet, doc_id * 100000 + sent_id AS seq FROM sentences),
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person, snippet ORDER BY seq) AS r FROM s) WHERE r = 1),
    u AS (SELECT DISTINCT person, lower(snippet) AS t FROM e WHERE person IS NOT NULL),
    g AS (SELECT DISTINCT a.person, a.t FROM u a JOIN u b ON a.person = b.person AND length(b.t) > length(a.t) AND contains(b.t, a.t)),
    c AS (SELECT e.topic FROM e LEFT JOIN g ON g.person = e.person AND g.t = lower(e.snippet) WHERE e.person IS NOT NULL AND g.t IS NULL)
    SELECT topic, count(*) AS before, coalesce((SELECT count(*) FROM e WHERE e.topic = s.topic), 0) AS exact, coalesce((SELECT count(*) FROM c WHERE c.topic = s.topic), 0) AS contained FROM s GROUP BY topic""")
def dedupe_counts(spark, d):
    """AGG28, DOM12, over all sentences of all texts."""
    from presslens.plans.snippets import dedupe_counts as run

    x = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("source").alias("person"), "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "snippet"))
    return run(x.withColumn("seq", F.col("doc_id") * 100_000 + F.col("i")), "topic")


@query("win06_latest_per_member", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest(spark, d):
    return D.latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("win07_random_cap", "SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY md5('42|' || event_id), event_id) AS r FROM events) WHERE r <= 5")
def random_cap(spark, d):
    """DOM07: at most five rows of each user in each type."""
    return S.cap(table(spark, d, "events"), ["event_type", "user_id"], "event_id", 5, 42).select("event_id", "event_type", "user_id")


@query("win08_sample", "SELECT event_id FROM events ORDER BY md5('7|' || event_id), event_id LIMIT 50")
def sample(spark, d):
    return S.sample(table(spark, d, "events"), "event_id", 50, 7).select("event_id")


@query("win11_first_k", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 2")
def first_k(spark, d):
    return D.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("win12_edge_dedupe", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def edge_dedupe(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("user_id").alias("person"), F.to_date("ts").alias("article_index"), F.lit(0).alias("snippet_index"), F.lit("R").alias("relation"), F.initcap("event_type").alias("cause"), F.lit("Effect").alias("effect"), F.col("value").alias("confidence"))
    return D.best_edges(x, "event_id").select("event_id")


@query("win14_capture_choice", "SELECT user_id, min_by(event_id, ts) AS first_event, max_by(event_id, ts) AS last_event FROM events GROUP BY user_id")
def capture_choice(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"))


@query("win15_limits", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5 ORDER BY event_type, event_id LIMIT 12")
def limits(spark, d):
    return corpus_views.limited(table(spark, d, "events"), "event_type", "event_id", 5, 12).select("event_type", "event_id")


@query("top01_newest", "SELECT event_id FROM events WHERE ts IS NOT NULL ORDER BY ts DESC, event_id LIMIT 25")
def newest(spark, d):
    x = table(spark, d, "events").withColumn("date", F.col("ts").cast("string"))
    return corpus.newest(x, 25, "date", "event_id").select("event_id")


@query("top02_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_groups(spark, d):
    return A.top_groups(table(spark, d, "events"), ["user_id"], 20)


@query("top03_topics_without_outlier", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM embeddings) WHERE label <> -1 GROUP BY label ORDER BY n DESC, label LIMIT 10")
def topics(spark, d):
    x = table(spark, d, "embeddings").withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label"))).where("label <> -1")
    return A.top_groups(x, ["label"], 10)


@query("srt01_sorted_head", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def sorted_head(spark, d):
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderdate")


@query("flt01_section_member", "SELECT doc_id FROM documents WHERE lower(trim(' ' || upper(source))) IN ('src1', 'src2', 'src3')")
def section_member(spark, d):
    return table(spark, d, "documents").where(L.among(F.concat(F.lit(" "), F.upper("source")), ["SRC1", "src2 ", "src3"])).select("doc_id")


@query("flt02_section_equal", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src7') OR lang = 'es'")
def section_equal(spark, d):
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src7") | (F.col("lang") == "es")).select("doc_id")


@query("flt04_between_instants", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 23:59:59'")
def between_instants(spark, d):
    return table(spark, d, "orders").where("o_orderdate BETWEEN timestamp_ntz'1995-01-01 00:00:00' AND timestamp_ntz'1996-12-31 23:59:59'").select("o_orderkey")


@query("flt06_title_patterns", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)apache license') AND regexp_matches(text, '(?i)version')")
def title_patterns(spark, d):
    return table(spark, d, "documents").where(L.all_match(F.col("text"), "apache license", "version")).select("doc_id")


@query("flt07_keyword_relevance", r"""
    SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bworthless\b') THEN 0 ELSE CAST(len(regexp_extract_all(text, '(?i)\bhate\b|\blicense\b|\bthe\b')) AS BIGINT) END AS score FROM documents) WHERE score >= 5""")
def relevance(spark, d):
    """DOM19's filter, FLT07, TXT07, TXT08."""
    x = table(spark, d, "documents").withColumn("score", L.relevance(F.col("text"), [r"\bhate\b", r"\blicense\b", r"\bthe\b"], [r"\bworthless\b"]))
    return x.where("score >= 5").select("doc_id", "score")


@query("dom19_politics", r"""
    WITH s AS (SELECT doc_id, source, CASE WHEN regexp_matches(text, '(?i)\bworthless\b') THEN 0 ELSE len(regexp_extract_all(text, '(?i)\bhate\b|\bthe\b')) END AS score FROM documents)
    SELECT doc_id FROM s WHERE source IN ('src1', 'src2') UNION SELECT doc_id FROM s WHERE source IN ('src2', 'src3') AND score >= 5""")
def politics(spark, d):
    """DOM19, SET02, WIN04."""
    return corpus.politics(table(spark, d, "documents"), "text", "source", ["src2", "src3"], ["src1", "src2"], "doc_id", [r"\bhate\b", r"\bthe\b"], [r"\bworthless\b"]).select("doc_id")


@query("flt08_url_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def url_prefix(spark, d):
    return table(spark, d, "pages").where(F.col("url").startswith("https://")).select("page_id")


@query("flt09_year_fallback", """
    SELECT event_id, CAST(coalesce(year(CASE WHEN event_type = 'click' THEN ts END), CAST(substr(CASE WHEN event_type = 'error' THEN 'none' ELSE '2023' END, 1, 4) AS BIGINT)) AS BIGINT) AS year FROM events WHERE event_type <> 'error'""")
def year_fallback(spark, d):
    x = table(spark, d, "events")
    year = L.year_or_fallback(F.when(F.col("event_type") == "click", F.col("ts")), F.when(F.col("event_type") == "error", "none").otherwise("2023"))
    return x.withColumn("year", year.cast("bigint")).where("year BETWEEN 1990 AND 2024").select("event_id", "year")


SPANS_SQL = "x AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE min(ts) END AS s, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(CASE WHEN value < 20 THEN ts END) END AS e FROM events GROUP BY user_id)"


def _spans(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max(F.when(F.col("value") < 20, F.col("ts"))).alias("b"))
    return g.select("user_id", F.when(F.col("user_id") % 7 != 0, F.col("a")).alias("s"), F.when(F.col("user_id") % 5 != 0, F.col("b")).alias("e"))


@query("flt10_interval_overlap", f"WITH {SPANS_SQL} SELECT user_id FROM x WHERE coalesce(s <= TIMESTAMP '2024-01-20', true) AND coalesce(e >= TIMESTAMP '2024-01-10', true)")
def interval_overlap(spark, d):
    lo, hi = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    return _spans(spark, d).where(L.overlaps(F.col("s"), F.col("e"), lo, hi)).select("user_id")


@query("flt11_strict_overlap", f"WITH {SPANS_SQL} SELECT user_id FROM x WHERE coalesce(s <= TIMESTAMP '2024-01-20', true) AND coalesce(e >= TIMESTAMP '2024-01-10', true) AND (s IS NOT NULL OR e IS NOT NULL)")
def strict_overlap(spark, d):
    lo, hi = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    return _spans(spark, d).where(L.overlaps(F.col("s"), F.col("e"), lo, hi, strict=True)).select("user_id")


@query("flt12_any_membership", "SELECT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' AND coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END, TIMESTAMP '2030-01-01') >= TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def any_membership(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("end"))).alias("m"))
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return x.where(L.any_overlap(F.col("m"), ts("1996-01-01"), ts("1996-06-30"), ts("2030-01-01"))).select("o_custkey")


@query("flt14_min_words", r"SELECT page_id FROM pages WHERE len(string_split_regex(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '\s+')) > 3")
def min_words(spark, d):
    return table(spark, d, "pages").where(T.word_count(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)) > 3).select("page_id")


@query("flt18_longer_than", "SELECT doc_id, CASE WHEN length(text) > 200 THEN length(text) END AS chars FROM documents")
def longer_than(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(L.longer(F.col("text"), 200)).cast("bigint").alias("chars"))


@query("set04_intersection", "SELECT user_id, list_sort(list_intersect(list_distinct(list(event_type) FILTER (WHERE value > 20)), ['click', 'error', 'none'])) AS kinds FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE value > 20) > 0")
def intersection(spark, d):
    x = table(spark, d, "events").where("value > 20").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return x.select("user_id", F.sort_array(F.array_intersect("k", F.array(F.lit("click"), F.lit("error"), F.lit("none")))).alias("kinds"))


TOPICS = [(0, "0_alpha_beta"), (1, "1_gamma"), (2, "2_delta_eps_zeta")]


@query("prj10_map_with_default", f"WITH {named(TOPICS, 'm', 'label, name')} SELECT vec_id, coalesce(m.name, 'Outlier') AS topic_name FROM embeddings e LEFT JOIN m ON e.label = m.label")
def map_default(spark, d):
    return schema.map_values(table(spark, d, "embeddings"), "label", constant(spark, TOPICS, "k, v", "int, string"), "k", "v", "topic_name", "Outlier").select("vec_id", "topic_name")


LABELS = [(0, "0_alpha{s}_beta"), (1, "1_gamma{s}"), (2, "2_delta_eps_zeta{s}"), (3, "none{s}"), (4, None)]


@query("txt21_label_words", f"WITH {spread_sql('m', LABELS, 'name', 'string')} SELECT c_custkey, replace(substr(name, strpos(name, '_') + 1), '_', ', ') AS words FROM m")
def label_words(spark, d):
    return spread(spark, d, LABELS, "name", "string").select("c_custkey", T.label_words(F.col("name")).alias("words"))


@query("prj12_file_safe", r"SELECT DISTINCT p_type, replace(trim(regexp_replace(p_name || '/' || p_type || ':é', '[^\p{L}\p{N} _-]', '_', 'g')), ' ', '_') AS safe FROM part")
def file_safe(spark, d):
    return table(spark, d, "part").select("p_type", T.file_safe(F.concat(F.col("p_name"), F.lit("/"), F.col("p_type"), F.lit(":é"))).alias("safe")).distinct()


@query("prj13_slug", "SELECT DISTINCT p_name, '<' || trim(regexp_replace(lower('--' || p_name || '.'), '[^a-z0-9]+', '_', 'g'), '_') || '>' AS tag FROM part")
def slug(spark, d):
    return table(spark, d, "part").select("p_name", T.tag_of(F.concat(F.lit("--"), F.col("p_name"), F.lit("."))).alias("tag")).distinct()


@query("prj14_recode", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'male' WHEN c_mktsegment = 'BUILDING' THEN 'female' ELSE 'unknown' END AS gender FROM customer")
def recode(spark, d):
    guess = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "male").when(F.col("c_mktsegment") == "MACHINERY", "mostly_male").when(F.col("c_mktsegment") == "BUILDING", "mostly_female").otherwise("andy")
    return table(spark, d, "customer").select("c_custkey", corpus_views.gender_class(guess).alias("gender"))


@query("prj09_json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def json_flatten(spark, d):
    """PRJ09, JSN01."""
    x = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return schema.flatten(x)


PAIRS = [("src1", "one", 1), ("src2", "two", 1), ("src2", "zwei", 2)]


@query("jon03_tag_lookup", f"WITH {named(PAIRS, 'g', 'tag, name, seq')} SELECT doc_id, name FROM documents JOIN (SELECT tag, max_by(name, seq) AS name FROM g GROUP BY tag) ON source = tag")
def tag_lookup(spark, d):
    return J.lookup(table(spark, d, "documents"), "source", constant(spark, PAIRS, "tag, name, seq", "string, string, int"), "tag", "name", order="seq").select("doc_id", "name")


@query("jon04_count_attach", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def count_attach(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return J.lookup(table(spark, d, "customer"), "c_custkey", n, "o_custkey", "n", default=0).select("c_custkey", "n")


@query("jon05_gender_default", f"WITH {named(PAIRS, 'g', 'tag, name, seq')} SELECT doc_id, coalesce(name, 'unknown') AS gender FROM documents LEFT JOIN (SELECT tag, max_by(name, seq) AS name FROM g GROUP BY tag) ON source = tag")
def gender_default(spark, d):
    return J.lookup(table(spark, d, "documents"), "source", constant(spark, PAIRS, "tag, gender, seq", "string, string, int"), "tag", "gender", default="unknown", order="seq").select("doc_id", "gender")


@query("jon02_row_key_join", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def row_key_join(spark, d):
    """JON02, JON20, PRJ11: attached by key, never by position."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@query("jon07_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("jon08_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jon19_annotator_zip", "SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS missing, count(*) AS n, sum(CAST(quality = toxic AS BIGINT))::BIGINT AS equal FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def annotator_zip(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select(F.col("doc_id").alias("k")), F.col("doc_id") == F.col("k"), "left")
    return x.agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("equal"))


@query("jon12_fuzzy_match", """
    WITH RECURSIVE k AS (SELECT unnest(['widget red', 'small rings', 'bolt blue', 'ring']) AS known), p AS (SELECT DISTINCT p_name FROM part),
    x AS (SELECT p_name, known, array_to_string(list_sort(string_split(lower(trim(p_name)), ' ')), ' ') AS a, array_to_string(list_sort(string_split(lower(trim(known)), ' ')), ' ') AS b FROM p, k),
    -- a row of the table of longest common subsequences for each character of a; of a row the values only rise, so a running maximum fills it
    l AS (SELECT p_name, known, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0::BIGINT) AS r FROM x
          UNION ALL
          SELECT p_name, known, a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda q: CASE WHEN q > 0 AND substr(a, i + 1, 1) = substr(b, q, 1) THEN r[q] + 1 ELSE r[q + 1] END))) FROM l WHERE i < length(a)),
    s AS (SELECT p_name, known, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS score FROM l WHERE i = length(a))
    SELECT p_name, known AS match, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, known) AS r FROM s WHERE score >= 85) WHERE r = 1""")
def fuzzy_match(spark, d):
    """JON12, TXT24."""
    known = constant(spark, [("widget red",), ("small rings",), ("bolt blue",), ("ring",)], "known")
    return J.fuzzy_best(table(spark, d, "part"), "p_name", known, "known", 85.0)


@query("agg01_person_gender_counts", "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, nullif(event_type, 'error') AS event_type FROM events) WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2")
def person_counts(spark, d):
    return A.group_count(table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error"))), ["user_id", "event_type"])


MF_SQL = "x AS (SELECT event_type AS topic, CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender, user_id AS person, value, event_id FROM events)"


def _mf(spark, d):
    g = F.when(F.col("user_id") % 3 == 0, "M").when(F.col("user_id") % 3 == 1, "F")
    return table(spark, d, "events").select(F.col("event_type").alias("topic"), g.alias("gender"), F.col("user_id").alias("person"), "value", "event_id")


@query("agg05_gender_breakdown", f"WITH {MF_SQL} SELECT topic, count(*) AS total, count(*) FILTER (WHERE gender = 'M') AS m, count(*) FILTER (WHERE gender = 'F') AS f, count(DISTINCT person) AS people, round(100.0 * count(*) FILTER (WHERE gender = 'F') / count(*), 6) AS pct_f FROM x GROUP BY ROLLUP (topic)")
def gender_breakdown(spark, d):
    return A.breakdown(_mf(spark, d), "topic", "gender", "person", total=True)


@query("agg02_summary_by_gender", f"WITH {MF_SQL} SELECT topic, gender, count(*) AS total, round(avg(value), 6) AS mean, round(sum(value), 4) AS sum FROM x GROUP BY 1, 2")
def summary_by_gender(spark, d):
    return _mf(spark, d).groupBy("topic", "gender").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("sum"))


@query("agg04_gender_pivot", f"WITH {MF_SQL}, s AS (SELECT topic, gender, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY 1, 2) SELECT topic, coalesce(max(n) FILTER (WHERE gender = 'M'), 0) AS male_n, coalesce(max(mean) FILTER (WHERE gender = 'M'), 0) AS male_mean, coalesce(max(n) FILTER (WHERE gender = 'F'), 0) AS female_n, coalesce(max(mean) FILTER (WHERE gender = 'F'), 0) AS female_mean FROM s GROUP BY topic")
def gender_pivot(spark, d):
    s = _mf(spark, d).groupBy("topic", "gender").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return A.by_gender(s, "topic", "gender", {"n": F.col("n"), "mean": F.col("mean")})


@query("jon01_before_after", f"""
    WITH {MF_SQL}, y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, person ORDER BY md5('42|' || event_id), event_id) AS r FROM x) WHERE r <= 3),
    a AS (SELECT topic, count(*) AS total, count(*) FILTER (WHERE gender = 'F') AS f FROM x GROUP BY topic), b AS (SELECT topic, count(*) AS total, count(*) FILTER (WHERE gender = 'F') AS f FROM y GROUP BY topic)
    SELECT topic, a.total AS total_before, a.f AS f_before, b.total AS total_after, b.f AS f_after FROM a JOIN b USING (topic)""")
def before_after(spark, d):
    x = _mf(spark, d)
    b = lambda df: A.breakdown(df, "topic", "gender", "person").select("topic", "total", "f")
    return J.compare(b(x), b(S.cap(x, ["topic", "person"], "event_id", 3, 42)), "topic")


@query("agg11_describe", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(min(n)::DOUBLE, 6) AS min, round(quantile_cont(n, 0.25)::DOUBLE, 6) AS q25, round(quantile_cont(n, 0.5)::DOUBLE, 6) AS q50, round(quantile_cont(n, 0.75)::DOUBLE, 6) AS q75, round(max(n)::DOUBLE, 6) AS max FROM c")
def describe(spark, d):
    return A.describe(A.group_count(table(spark, d, "events"), ["user_id"]), "n")


@query("agg12_top_share", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, user_id LIMIT 10))::BIGINT AS top, sum(n)::BIGINT AS total, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, user_id LIMIT 10))::DOUBLE / sum(n), 6) AS share FROM c")
def top_share(spark, d):
    return A.top_share(A.group_count(table(spark, d, "events"), ["user_id"]), "n", 10, ["user_id"])


@query("agg13_cap_sweep", """
    WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT unnest([10, 20, 30, 50, 75, 100, 150, 200]) AS cap), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rank FROM c)
    SELECT cap::BIGINT AS cap, sum(least(n, cap))::BIGINT AS kept, round_even(100.0::DOUBLE * sum(least(n, cap)) / sum(n), 1) AS kept_pct, round_even(100.0::DOUBLE * coalesce(sum(least(n, cap)) FILTER (WHERE rank <= 10), 0) / sum(least(n, cap)), 1) AS top_pct, count(*) FILTER (WHERE n > cap) AS capped FROM r, k GROUP BY cap""")
def sweep(spark, d):
    """AGG13, MTH02, MTH03."""
    return A.cap_sweep(A.group_count(table(spark, d, "events"), ["user_id"]), "n", corpus_views.CAPS)


@query("agg16_edge_aggregate", "SELECT CAST(ts AS DATE) AS article_index, user_id AS person, count(*) AS edge_count, round(avg(value), 6) AS mean_conf, max(value) AS max_conf FROM events GROUP BY 1, 2")
def edge_aggregate(spark, d):
    from presslens.plans.causal import aggregate

    return aggregate(table(spark, d, "events").select(F.to_date("ts").alias("article_index"), F.col("user_id").alias("person"), F.col("value").alias("confidence")))


@query("agg23_agreement", """
    WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels),
    m AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc, 2 * tp / (2 * tp + fp + fn) AS f, 2 * tn / (2 * tn + fp + fn) AS f0, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS e FROM c)
    SELECT n::BIGINT AS n, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(f, 6) AS f1, round(f0, 6) AS f1_zero, round((f + f0) / 2, 6) AS macro_f1, round((f * (tp + fn) + f0 * (tn + fp)) / n, 6) AS weighted_f1, round((acc - e) / (1 - e), 6) AS kappa FROM m""")
def agreement(spark, d):
    """DOM23's measure."""
    return A.agreement(table(spark, d, "labels"), "quality", "toxic")


@query("agg24_group_ratio", f"WITH {MF_SQL} SELECT gender, round(sum(s) / count(person), 4) AS score, count(person) AS n FROM (SELECT person, max(gender) AS gender, sum(value) AS s FROM x GROUP BY person) GROUP BY gender")
def group_ratio(spark, d):
    from presslens.plans.personas import group_scores

    x = _mf(spark, d)
    s = x.groupBy(F.col("person").alias("persona")).agg(F.sum("value").alias("score"))
    return group_scores(s, x.groupBy(F.col("person").alias("persona")).agg(F.max("gender").alias("gender")), "gender").select("gender", F.round("score", 4).alias("score"), "n")


@query("agg27_run_counters", "SELECT CASE WHEN length(text) > 200 THEN 'success' ELSE 'no_text' END AS status, count(*) AS n FROM documents GROUP BY 1")
def run_counters(spark, d):
    return table(spark, d, "documents").groupBy(F.when(F.length("text") > 200, "success").otherwise("no_text").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("snk08_page_key", "SELECT page_id, sha1(url || '|' || page_id) AS key FROM pages")
def page_key(spark, d):
    """SNK08, TXT25."""
    from presslens.sources.files import page_keys

    return page_keys(table(spark, d, "pages").withColumn("stamp", F.col("page_id").cast("string"))).select("page_id", "key")


@query("mth04_probabilities", "SELECT event_id, round(1 / (1 + exp(-value / 10)), 9) AS logistic, round(1 / (1 + exp(1 - value / 10)), 9) AS softmax, round(value * 0.5, 6) AS combined FROM events WHERE value * 0.5 >= 5")
def probabilities(spark, d):
    """MTH04, MTH05."""
    x = table(spark, d, "events").where(F.col("value") * 0.5 >= 5)
    return x.select("event_id", F.round(V.logistic(F.col("value") / 10), 9).alias("logistic"), F.round(V.positive_probability(F.lit(1.0), F.col("value") / 10), 9).alias("softmax"), F.round(F.col("value") * 0.5, 6).alias("combined"))


@query("mth01_safe_ratio", "SELECT doc_id, round(quality / (toxic + 1e-9), 3) AS r FROM labels")
def safe_ratio(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round(V.ratio(F.col("quality"), F.col("toxic")), 3).alias("r"))


@query("dat02_any_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def any_date(spark, d):
    """DAT01, DAT02: every order's date in one of five forms, junk or null, and back."""
    day = lambda f: F.date_format("o_orderdate", f)
    forms = [F.concat(day("yyyy-MM-dd"), F.lit("T03:04:05Z")), day("yyyy-MM-dd"), day("dd-MM-yyyy"), day("dd/MM/yyyy"), day("yyyy/MM/dd"), F.lit("junk"), F.lit(None).cast("string")]
    s = F.get(F.array(*forms), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(V.any_timestamp(s)).cast("string").alias("day"))


@query("dat03_archive_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(year(ts) AS BIGINT) AS year, strftime(ts, '%Y-%m-%d') AS day FROM events")
def archive_stamp(spark, d):
    """DAT03, DAT04, DAT05."""
    t = V.stamp(F.date_format("ts", "yyyyMMddHHmmss"))
    return table(spark, d, "events").select("event_id", V.iso(t).alias("iso"), F.year(t).cast("bigint").alias("year"), V.day(V.iso(t)).alias("day"))


@query("jsn02_text_or_object", "SELECT event_id, 'd' || CAST(json_extract(props, '$.k') AS VARCHAR) AS date FROM events")
def text_or_object(spark, d):
    k = F.concat(F.lit("d"), F.get_json_object("props", "$.k"))
    json = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.concat(F.lit('{"#text": "'), k, F.lit('"}')))
    return table(spark, d, "events").select("event_id", V.text_or_object(json).alias("date"))


@query("arr01_split_list", "SELECT DISTINCT p_name, list_filter(list_transform(string_split(p_name || '; ;' || p_type || ';', ';'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def split_list(spark, d):
    return table(spark, d, "part").select("p_name", V.list_of(F.concat(F.col("p_name"), F.lit("; ;"), F.col("p_type"), F.lit(";"))).alias("parts")).distinct()


@query("arr04_first_string", "SELECT p_partkey, p_brand AS first FROM part")
def first_string(spark, d):
    none = F.array(F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", V.first_string(F.array(none, F.array("p_brand", "p_type"))).alias("first"))


@query("map01_dict_of_columns", "SELECT p_brand, max(p_size) AS largest FROM part GROUP BY 1")
def dict_of_columns(spark, d):
    """MAP01, MAP02: a map of the brands' largest sizes, looked up."""
    m = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("s"))
    one = m.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "s"))).alias("m"))
    return m.select("p_brand").crossJoin(one).select("p_brand", F.try_element_at("m", F.col("p_brand")).alias("largest"))


@query("prj05_lower_names", "SELECT c_custkey AS key, c_name AS \"the name\" FROM customer")
def lower_names(spark, d):
    return schema.lower_names(table(spark, d, "customer").select(F.col("c_custkey").alias(" KEY "), F.col("c_name").alias("The Name")))


@query("prj06_text_column", "SELECT doc_id, 'BodyContent' AS which, length(text) AS n FROM documents WHERE text IS NOT NULL")
def text_column(spark, d):
    """PRJ06: of the usual names the one the table has, whatever its case."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("BodyContent"), "source").where("BodyContent IS NOT NULL")
    found = schema.text_column(docs)
    return docs.select("doc_id", F.lit(found).alias("which"), F.length(found).cast("long").alias("n"))


@query("prj07_required", "SELECT * FROM (VALUES ('documents', true, ''), ('customer', false, 'source,text'), ('events', false, 'source,text')) AS t(name, complete, missing)")
def required(spark, d):
    """PRJ07, SET05: which tables have the columns that an operator needs, and what the others lack; the plan tells, no row is read."""
    rows = []
    for name in ("documents", "customer", "events"):
        df = table(spark, d, name)
        missing = sorted({"text", "source"} - set(df.columns))
        try:
            schema.require(df, "text", "source")
            rows.append((name, schema.has(df, "text", "source"), ",".join(missing)))
        except ValueError:
            rows.append((name, schema.has(df, "text", "source"), ",".join(missing)))
    return constant(spark, [(n, str(c).lower(), m) for n, c, m in rows], "name, complete, missing", "string, boolean, string")
