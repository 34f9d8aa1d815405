"""Sentence, mention, snippet, frame, HTML and representation queries."""

from pyspark.sql import functions as F

from presslens.functions import html as H
from presslens.functions import text as T
from presslens.operators import joins as J
from presslens.plans import corpus_views, frames, mentions
from presslens.queries import constant, literal, named, query, spread, spread_sql, table

#: People whose names occur in the texts, with a gender.
PEOPLE = [("Apache License", "M"), ("General Public", "F"), ("Orre Orre", None), ("The The", "F")]
NAMES = {n.lower(): "<" + n.lower().replace(" ", "_") + ">" for n, _ in PEOPLE}
#: SQL for the sentences of documents: a mark is put between a stop and the next capital, twice since a match takes the capital with it.
MARKED = r"""regexp_replace(regexp_replace({t}, '\s*\n+\s*', ' ', 'g'), '([.!?])\s+([A-Z"‘’“”])', '\1' || chr(1) || '\2', 'g')"""
SENTENCES_SQL = """
    marked AS (SELECT doc_id, source, lang, {m2} AS t FROM documents),
    cut AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(t, chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM marked),
    sentences AS (SELECT doc_id, source, lang, CAST(unnest(range(len(l))) AS INTEGER) AS sent_id, unnest(l) AS sentence FROM cut)""".format(m2=r"""regexp_replace({}, '([.!?])\s+([A-Z"‘’“”])', '\1' || chr(1) || '\2', 'g')""".format(MARKED.format(t="{text}")))


def sentences_sql(text: str = "coalesce(text, '')") -> str:
    return SENTENCES_SQL.replace("{text}", text)


def tagged_sql() -> str:
    t = "coalesce(text, '')"
    for n in sorted(NAMES, key=lambda n: (-len(n), n)):
        t = rf"regexp_replace({t}, '(?i)\b{n}\b', '{NAMES[n]}', 'g')"
    return t


def _tagged(spark, d):
    return table(spark, d, "documents").withColumn("tagged_text", mentions.tag_names(F.coalesce("text", F.lit("")), NAMES))


def _gazetteer(spark):
    return constant(spark, PEOPLE, "name_final, gender")


MENTIONS_SQL = sentences_sql(tagged_sql()) + f""",
    {named(PEOPLE, "people", "mp, gender")},
    tagged AS (SELECT doc_id, source, lang, sent_id, sentence, unnest(regexp_extract_all(sentence, '<([a-z0-9_]+)>', 1)) AS tag FROM sentences),
    mentioned AS (SELECT t.*, mp, gender FROM tagged t JOIN people ON tag = replace(lower(mp), ' ', '_'))"""


@query("txt03_sentence_count", f"WITH {sentences_sql()} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM sentences GROUP BY doc_id")
def sentence_count(spark, d):
    """TXT02, TXT03, ARR02."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).cast("bigint").alias("chars"))


@query("arr02_sentences", f"WITH {sentences_sql()} SELECT doc_id, sent_id, md5(sentence) AS digest FROM sentences")
def sentence_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "s")).select("doc_id", "sent_id", F.md5(F.col("s").cast("binary")).alias("digest"))


def _held(sql: str) -> str:
    words = "|".join(a.replace(".", r"\.") for a in sorted(T.ABBREVIATIONS, key=lambda a: (-len(a), a)))
    return rf"regexp_replace({sql}, '(^|[^\p{{L}}\p{{N}}_])({words}|[A-Z])\.', '\1\2' || chr(2), 'g')"


@query("txt04_careful_sentences", f"WITH {sentences_sql(_held(chr(39) + 'Dr. X. Orre vs. St. Orre: ' + chr(39) + ' || coalesce(text, ' + chr(39) * 2 + ')'))} SELECT doc_id, sent_id, md5(replace(sentence, chr(2), '.')) AS digest FROM sentences")
def careful_sentences(spark, d):
    """TXT04, over all texts with abbreviations put before them."""
    text = F.concat(F.lit("Dr. X. Orre vs. St. Orre: "), F.coalesce("text", F.lit("")))
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.careful_sentences(text)).alias("sent_id", "s"))
    return x.select("doc_id", "sent_id", F.md5(F.col("s").cast("binary")).alias("digest"))


@query("txt01_squeeze", r"SELECT page_id, md5(trim(regexp_replace(replace(html, chr(160), ' '), '\s+', ' ', 'g'))) AS digest FROM pages")
def squeeze(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.squeeze(F.col("html")).cast("binary")).alias("digest"))


@query("txt05_word_tokens", r"SELECT lang, count(*) AS n, count(DISTINCT w) AS different FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY lang")
def word_tokens(spark, d):
    x = table(spark, d, "documents").select("lang", F.explode(T.word_tokens(F.col("text"))).alias("w"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w").alias("different"))


@query("txt06_word_count", r"SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END AS BIGINT) AS n FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n"))


@query("dom02_tag_names", rf"SELECT doc_id, md5({tagged_sql()}) AS digest, CAST(len(regexp_extract_all({tagged_sql()}, '<[a-z0-9_]+>')) AS BIGINT) AS n FROM documents")
def tag_names(spark, d):
    """The whole-name step of DOM02, as an expression."""
    return _tagged(spark, d).select("doc_id", F.md5(F.col("tagged_text").cast("binary")).alias("digest"), F.regexp_count("tagged_text", F.lit("<[a-z0-9_]+>")).cast("bigint").alias("n"))


@query("dom02_tagger", rf"SELECT doc_id, md5(CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE {tagged_sql()} END) AS digest FROM documents")
def tagger(spark, d):
    """DOM03b: the worker-side tagger with every name ungated gives what the expression gives."""
    names = constant(spark, list(NAMES.items()), "alias, tag")
    gated = constant(spark, [("none", "<none>")], "word, tag")
    out = mentions.tag(table(spark, d, "documents").select("doc_id", "text"), names, gated, text="text", mode="all")
    return out.select("doc_id", F.md5(F.col("tagged_text").cast("binary")).alias("digest"))


#: Texts with clusters of character spans, and what the tagger makes of them with coreference and with near names. {s} is one character, so that spans stay.
TO_TAG = [
    (0, "Boris Johnson{s} spoke. He left. Then Johnson{s} went.", "[[[0,14],[22,24]]]", "<boris_johnson{s}> spoke. <boris_johnson{s}> left. Then <boris_johnson{s}> went.", "<boris_johnson{s}> spoke. He left. Then <boris_johnson{s}> went."),
    (1, "Somebody spoke. He left.", "[[[0,8],[16,18]]]", "Somebody spoke. Somebody left.", "Somebody spoke. He left."),
    (2, None, None, "", ""),
    (3, "Then a Johnson{s} spoke.", "[]", "Then a Johnson{s} spoke.", "Then a Johnson{s} spoke."),
    (4, "We saw Boriss Johnson{s}. She was Theresa Mary May{s}.", "[[[24,27],[32,49]]]", "We saw Boriss Johnson{s}. <theresa_mary_may{s}> was <theresa_mary_may{s}>.", "We saw <boris_johnson{s}>. She was <theresa_mary_may{s}>."),
    (5, "theresa may{s} and THERESA MARY MAY{s} met May{s} in May.", "[]", "<theresa_mary_may{s}> and <theresa_mary_may{s}> met <theresa_mary_may{s}> in May.", "<theresa_mary_may{s}> and <theresa_mary_may{s}> met <theresa_mary_may{s}> in May."),
]
TAGGED_SQL = spread_sql("x", [(c, coref, ner) for c, _, _, coref, ner in TO_TAG], "coref, ner", "string, string")


def _tagged_texts(spark, d, mode):
    from presslens.plans import gazetteer

    people = spark.range(26).select(F.explode(F.array(*[F.concat(F.lit(n), F.chr(F.lit(97) + F.col("id"))) for n in ("Boris Johnson", "Theresa Mary May")])).alias("name_final"))
    rows = gazetteer.aliases(people)
    x = spread(spark, d, [(c, text, spans) for c, text, spans, _, _ in TO_TAG], "text, spans", "string, string")
    spans = F.from_json("spans", "array<array<array<int>>>")
    x = x.withColumn("coref", F.transform(spans, lambda c: F.transform(c, lambda s: F.struct(s[0].alias("start"), s[1].alias("end")))))
    out = mentions.tag(x, gazetteer.name_table(rows), gazetteer.gated_words(rows), text="text", mode=mode, coref="coref" if mode == "coref" else None)
    return out.select("c_custkey", "tagged_text", "tag_error")


@query("dom02_tag_coref", f"WITH {TAGGED_SQL} SELECT c_custkey, coref AS tagged_text, CAST(NULL AS VARCHAR) AS tag_error FROM x")
def tag_coref(spark, d):
    """DOM02 with pronouns resolved by coreference spans, then names and gated single words; JON18, FLT15, ARR03."""
    return _tagged_texts(spark, d, "coref")


@query("dom03_tag_ner", f"WITH {TAGGED_SQL} SELECT c_custkey, ner AS tagged_text, CAST(NULL AS VARCHAR) AS tag_error FROM x")
def tag_ner(spark, d):
    """DOM03: names, gated words, then near names; a lone surname stays where its person isn't named."""
    return _tagged_texts(spark, d, "ner")


@query("dom06_sentence_passives", f"WITH {sentences_sql()} SELECT doc_id, sent_id, CAST(len(regexp_extract_all(sentence, $re${frames.PASSIVE}$re$)) AS BIGINT) AS n FROM sentences WHERE regexp_matches(sentence, $re${frames.PASSIVE}$re$)")
def sentence_passives(spark, d):
    """DOM06 by sentence."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "sentence"))
    return x.select("doc_id", "sent_id", frames.passive_count(F.col("sentence")).cast("long").alias("n")).where("n > 0")


DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("str04_stream_scoring", f"WITH {MENTIONS_SQL} SELECT doc_id, sent_id, mp, gender, md5(sentence) AS digest, CAST(len(regexp_extract_all(sentence, $re${frames.PASSIVE}$re$)) AS BIGINT) AS passives FROM mentioned")
def stream_scoring(spark, d):
    """STR04: texts that arrive are tagged, cut into the sentences that mention people, and scored, by the functions that tables use."""
    from presslens.streaming import streams

    def score(df):
        tagged = df.withColumn("tagged_text", mentions.tag_names(F.coalesce("text", F.lit("")), NAMES))
        x = mentions.extract(tagged, _gazetteer(spark), keep=["doc_id"])
        return x.select("doc_id", "sent_id", "mp", "gender", F.md5(F.col("sentence").cast("binary")).alias("digest"), frames.passive_count(F.col("sentence")).cast("long").alias("passives"))

    return streams.drain(streams.score_stream(streams.read_stream(spark, f"{d}/documents*.parquet", DOCUMENT_SCHEMA), score))


@query("dom04_person_sentences", f"WITH {MENTIONS_SQL} SELECT doc_id, sent_id, mp, gender, md5(sentence) AS digest FROM mentioned")
def person_sentences(spark, d):
    """DOM04, TXT09, JON03."""
    x = mentions.extract(_tagged(spark, d), _gazetteer(spark), keep=["doc_id"])
    return x.select("doc_id", "sent_id", "mp", "gender", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query("agg01_mentions_by_person", f"WITH {MENTIONS_SQL} SELECT mp, gender, count(*) AS n FROM mentioned WHERE gender IS NOT NULL GROUP BY 1, 2")
def mentions_by_person(spark, d):
    from presslens.operators.aggregates import group_count

    return group_count(mentions.extract(_tagged(spark, d), _gazetteer(spark)), ["mp", "gender"])


@query("dom07_normalised_mentions", f"WITH {MENTIONS_SQL} SELECT lang, mp, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang, mp ORDER BY md5('42|' || doc_id || ':' || sent_id), doc_id || ':' || sent_id) AS r FROM (SELECT DISTINCT lang, mp, doc_id, sent_id FROM mentioned)) WHERE r <= 5 GROUP BY 1, 2")
def normalised_mentions(spark, d):
    x = mentions.extract(_tagged(spark, d), _gazetteer(spark), keep=["doc_id", "lang"], distinct=True).withColumn("key", F.concat_ws(":", "doc_id", "sent_id"))
    return corpus_views.normalise(x, "lang", "mp", "gender", "key", 5)["capped"].groupBy("lang", "mp").agg(F.count(F.lit(1)).alias("n"))


SNIPPETS_SQL = f"""WITH {MENTIONS_SQL},
    w AS (SELECT doc_id, sent_id, string_agg(sentence, ' ') OVER s AS snippet, min(sent_id) OVER s AS lo, max(sent_id) OVER s AS hi FROM sentences WINDOW s AS (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
    snippets AS (SELECT DISTINCT doc_id, mp AS person, lo, hi, snippet FROM w JOIN mentioned USING (doc_id, sent_id))"""


@query("win09_sentence_windows", f"{SNIPPETS_SQL} SELECT doc_id, person, lo, hi, CAST(row_number() OVER (PARTITION BY doc_id, person ORDER BY lo, hi) AS INTEGER) AS snippet_index, md5(snippet) AS digest FROM snippets")
def sentence_windows(spark, d):
    """WIN09, WIN10, JON17."""
    w = mentions.mention_windows(_tagged(spark, d), _gazetteer(spark), 1, keep=["doc_id"])
    out = J.numbered(w, ["doc_id", "person"], ["lo", "hi"], "snippet_index")
    return out.select("doc_id", "person", "lo", "hi", "snippet_index", F.md5(F.col("snippet").cast("binary")).alias("digest"))


#: Frequent words of the texts in the ten categories.
MORAL = [("the", "care.virtue"), ("of", "care.vice"), ("and", "fairness.virtue"), ("hate", "fairness.vice"), ("to", "loyalty.virtue"), ("he", "loyalty.vice"), ("le", "authority.virtue"), ("der", "authority.vice"), ("la", "sanctity.virtue"), ("worthless", "sanctity.vice"), ("the", "sanctity.vice")]
CATS = frames.CATEGORIES


def _moral_sql() -> str:
    hits = " + ".join(f"c{i}" for i in range(10))
    flags = ", ".join(f"max(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS c{i}" for i, c in enumerate(CATS))
    sums = ", ".join(f"coalesce(sum(c{i}), 0) AS c{i}" for i in range(10))
    valence = " + ".join(f"{'' if i % 2 == 0 else '-'}(CASE WHEN {hits} > 0 THEN c{i}::DOUBLE / ({hits}) ELSE 0 END)" for i in range(10))
    return rf"""{named(MORAL, "dict", "word, category")}, flags AS (SELECT word, {flags} FROM dict GROUP BY word),
    words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
    sums AS (SELECT doc_id, count(*) AS n, count(c0) AS moral, {sums} FROM words LEFT JOIN flags USING (word) GROUP BY doc_id),
    scores AS (SELECT doc_id, {valence} AS valence, moral / (n - moral + 1e-9) AS ratio FROM sums),
    scored AS (SELECT d.doc_id, lang, source, coalesce(valence, 0) AS valence, coalesce(valence, 0) / (coalesce(ratio, 0) + 1e-9) AS valence_norm FROM documents d LEFT JOIN scores USING (doc_id))"""


def _scored(spark, d):
    return frames.moral_scores(table(spark, d, "documents"), "doc_id", "text", constant(spark, MORAL, "word, category"))


@query("dom05_moral_valence", f"WITH {_moral_sql()} SELECT doc_id, round(valence, 6) AS valence, round(CASE WHEN valence = 0 THEN 0 ELSE valence_norm END, 4) AS valence_norm FROM scored")
def moral_valence(spark, d):
    """DOM05, TXT29, MTH01."""
    return _scored(spark, d).select("doc_id", F.round("valence", 6).alias("valence"), F.round(F.when(F.col("valence") == 0, 0.0).otherwise(F.col("valence_norm")), 4).alias("valence_norm"))


@query("agg02_moral_by_gender", f"""WITH {_moral_sql()}, g AS (SELECT source AS topic, CASE lang WHEN 'en' THEN 'M' WHEN 'fr' THEN 'F' END AS gender, count(*) AS total, avg(valence) AS m FROM scored GROUP BY 1, 2)
    SELECT topic, coalesce(max(total) FILTER (WHERE gender = 'M'), 0) AS male_total, round(coalesce(max(m) FILTER (WHERE gender = 'M'), 0), 6) AS male_valence_mean, coalesce(max(total) FILTER (WHERE gender = 'F'), 0) AS female_total, round(coalesce(max(m) FILTER (WHERE gender = 'F'), 0), 6) AS female_valence_mean FROM g GROUP BY topic""")
def moral_by_gender(spark, d):
    x = _scored(spark, d).withColumn("gender", F.when(F.col("lang") == "en", "M").when(F.col("lang") == "fr", "F")).withColumnRenamed("source", "topic")
    w = frames.wide(frames.moral_by_gender(x), "topic", ["total", "valence_mean"])
    return w.select("topic", "male_total", F.round("male_valence_mean", 6).alias("male_valence_mean"), "female_total", F.round("female_valence_mean", 6).alias("female_valence_mean"))


WEIGHTED = [("the", 0.5, 0.1, 0.1, 0.2, 0.1, 0.4, -0.2, 0.1, 0.0, -0.3), ("of", 0.1, 0.6, 0.1, 0.1, 0.1, -0.4, 0.2, 0.1, 0.5, 0.3), ("le", 0.2, 0.2, 0.3, 0.2, 0.1, 0.1, 0.1, -0.1, 0.2, 0.2)]
WEIGHTED_NAMES = ", ".join([*[f"{f}_p" for f in frames.FOUNDATIONS], *[f"{f}_sent" for f in frames.FOUNDATIONS]])


def _mean(c: str, name: str) -> str:
    """An exact mean, rounded."""
    return f"round(sum(CAST({c} AS DECIMAL(20, 10)))::DOUBLE / count(*), 6) + 0.0 AS {name}"


def _variance(names: list[str]) -> str:
    mean = f"(({' + '.join(names)}) / {len(names)})"
    return "(" + " + ".join(f"({n} - {mean}) * ({n} - {mean})" for n in names) + f") / {len(names) - 1}"


WEIGHTED_SQL = rf"WITH {named(WEIGHTED, 'dict', 'word, ' + WEIGHTED_NAMES)}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents)"
BOTH = [(f"{f}_{k}", f"{f}_{k}") for f in frames.FOUNDATIONS for k in ("p", "sent")]


@query("dom05b_word_probabilities", f"""
    {WEIGHTED_SQL}, m AS (SELECT doc_id, count(*) AS moral_words, {", ".join(f"sum(CAST({c} AS DECIMAL(20, 10)))::DOUBLE / count(*) AS {n}" for c, n in BOTH)} FROM w JOIN dict USING (word) GROUP BY doc_id)
    SELECT doc_id, moral_words, {", ".join(f"round({n}, 6) + 0.0 AS {n}" for _, n in BOTH)}, {_variance([f"{f}_p" for f in frames.FOUNDATIONS])} AS f_var, {_variance([f"{f}_sent" for f in frames.FOUNDATIONS])} AS sent_var FROM m""")
def word_probabilities(spark, d):
    dictionary = constant(spark, WEIGHTED, "word, " + WEIGHTED_NAMES, "string" + ", double" * 10)
    x = frames.word_probabilities(table(spark, d, "documents"), "doc_id", "text", dictionary)
    return x.select("doc_id", "moral_words", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c, _ in BOTH], "f_var", "sent_var")


def _top(i: int) -> str:
    """Whether foundation i is a word's most probable, ties in order."""
    f = frames.FOUNDATIONS
    return " AND ".join(["TRUE", *(f"{f[i]}_p > {x}_p" for x in f[:i]), *(f"{f[i]}_p >= {x}_p" for x in f[i + 1 :])])


@query("dom05b_single", f"{WEIGHTED_SQL} SELECT doc_id, count(*) AS moral_words, " + ", ".join(_mean(f"CASE WHEN {_top(i)} THEN {f}_{k} ELSE 0 END", f"{f}_{k}") for i, f in enumerate(frames.FOUNDATIONS) for k in ("p", "sent")) + " FROM w JOIN dict USING (word) GROUP BY doc_id")
def single(spark, d):
    dictionary = constant(spark, WEIGHTED, "word, " + WEIGHTED_NAMES, "string" + ", double" * 10)
    x = frames.word_probabilities(table(spark, d, "documents"), "doc_id", "text", dictionary, single=True)
    return x.select("doc_id", "moral_words", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c, _ in BOTH])


@query("dom05b_single_vice_virtue", f"{WEIGHTED_SQL} SELECT doc_id, count(*) AS moral_words, " + ", ".join(_mean(f"CASE WHEN {f}_sent {sign} 0 AND {_top(i)} THEN {f}_p ELSE 0 END", f"{f}_{name}") for i, f in enumerate(frames.FOUNDATIONS) for sign, name in ((">", "virtue"), ("<", "vice"))) + " FROM w JOIN dict USING (word) GROUP BY doc_id")
def single_vice_virtue(spark, d):
    dictionary = constant(spark, WEIGHTED, "word, " + WEIGHTED_NAMES, "string" + ", double" * 10)
    x = frames.word_probabilities(table(spark, d, "documents"), "doc_id", "text", dictionary, single=True, vice_virtue=True)
    return x.select("doc_id", "moral_words", *[(F.round(f"{f}_{k}", 6) + F.lit(0.0)).alias(f"{f}_{k}") for f in frames.FOUNDATIONS for k in ("virtue", "vice")])


FULL = frames.PASSIVE + r"\s+by\b"
PASSIVES = [(0, "The deal{s} was signed by Smith{s}."), (1, "It was never broken and is being mended{s} by hand."), (2, "He signed{s} it."), (3, "Rules{s} were quietly changed."), (4, None)]


@query("dom06_passive_kinds", f"WITH {spread_sql('x', PASSIVES, 'sentence', 'string')} SELECT c_custkey, CAST(len(regexp_extract_all(sentence, $re${FULL}$re$)) AS INTEGER) AS n_full, CAST(len(regexp_extract_all(sentence, $re${frames.PASSIVE}$re$)) - len(regexp_extract_all(sentence, $re${FULL}$re$)) AS INTEGER) AS n_truncated FROM x")
def passive_kinds(spark, d):
    """DOM06's full and truncated passives."""
    k = frames.passive_kinds(F.col("sentence"))
    return spread(spark, d, PASSIVES, "sentence", "string").select("c_custkey", k["full"].alias("n_full"), k["truncated"].alias("n_truncated"))


@query("dom05c_ngrams", f"WITH {named(MORAL, 'dict', 'word, category')}, g AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents) GROUP BY 1, 2) SELECT source, category, sum(n)::BIGINT AS n FROM g JOIN dict ON w = word GROUP BY 1, 2")
def ngrams(spark, d):
    """DOM05c over counted words."""
    g = table(spark, d, "documents").select("source", F.explode(T.word_tokens(F.col("text"))).alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    return frames.ngram_scores(g, "source", "w", "n", constant(spark, MORAL, "word, category"))


@query("dom05c_wordlist", rf"WITH {named(MORAL, 'dict', 'word, category')}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM documents) SELECT doc_id, category, count(*) AS n FROM w JOIN dict USING (word) GROUP BY 1, 2")
def wordlist(spark, d):
    return frames.wordlist_counts(table(spark, d, "documents"), "doc_id", "text", constant(spark, MORAL, "word, category"))


@query("dom06_passive_rate", f"""
    WITH {sentences_sql()}, p AS (SELECT lang AS topic, CASE WHEN source IN ('src0', 'src1') THEN 'M' WHEN source = 'src2' THEN 'F' END AS gender, len(regexp_extract_all(sentence, $re${frames.PASSIVE}$re$)) AS n FROM sentences),
    g AS (SELECT topic, gender, count(*) AS total, sum(n)::BIGINT AS passives FROM p GROUP BY 1, 2)
    SELECT topic, coalesce(max(total) FILTER (WHERE gender = 'M'), 0) AS male_total, coalesce(max(passives) FILTER (WHERE gender = 'M'), 0) AS male_passives, round(coalesce(max(passives::DOUBLE / total) FILTER (WHERE gender = 'M'), 0), 6) AS male_passive_rate,
           coalesce(max(total) FILTER (WHERE gender = 'F'), 0) AS female_total, coalesce(max(passives) FILTER (WHERE gender = 'F'), 0) AS female_passives, round(coalesce(max(passives::DOUBLE / total) FILTER (WHERE gender = 'F'), 0), 6) AS female_passive_rate FROM g GROUP BY topic""")
def passive_rate(spark, d):
    """DOM06, AGG03, AGG04."""
    x = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.when(F.col("source").isin("src0", "src1"), "M").when(F.col("source") == "src2", "F").alias("gender"), F.explode(T.sentences(F.col("text"))).alias("sentence"))
    w = frames.wide(frames.passive_by_gender(x.withColumn("passives", frames.passive_count(F.col("sentence")))), "topic", ["total", "passives", "passive_rate"])
    return w.withColumns({f"{g}_passive_rate": F.round(f"{g}_passive_rate", 6) for g in ("male", "female")})


@query("agg14_term_totals", r"SELECT sum(len(list_filter(t, lambda w: w IN ('the', 'he', 'his'))))::BIGINT AS male, sum(len(list_filter(t, lambda w: w IN ('of', 'hate'))))::BIGINT AS female FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def term_totals(spark, d):
    return corpus_views.gender_terms(table(spark, d, "documents"), "text", {"male": ["the", "he", "his"], "female": ["of", "hate"]})


COUNTED = [("Apache License",), ("of the",), ("the",), ("Nobody Here",)]


@query("agg15_name_frequency", rf"""
    WITH {named(COUNTED, "names", "name")}, t AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), '  ') || ' ' AS t FROM documents)
    SELECT name, sum((length(t) - length(replace(t, ' ' || replace(lower(name), ' ', '  ') || ' ', ''))) // (length(replace(name, ' ', '  ')) + 2))::BIGINT AS frequency FROM names, t GROUP BY name""")
def name_frequency(spark, d):
    """AGG15, DOM22."""
    return corpus_views.name_frequency(table(spark, d, "documents"), "text", constant(spark, COUNTED, "name"))


@query("txt20_topic_labels", r"""
    WITH t AS (SELECT lang, w, count(*) AS tf FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) GROUP BY 1, 2),
    a AS (SELECT w, sum(tf) AS n FROM t GROUP BY w), m AS (SELECT sum(tf) / count(DISTINCT lang) AS mean FROM t),
    s AS (SELECT lang, w, tf * ln(1 + mean / n) AS score FROM t JOIN a USING (w), m), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, w) AS r FROM s)
    SELECT lang, lang || '_' || string_agg(w, '_' ORDER BY r) AS label FROM r WHERE r <= 4 GROUP BY lang""")
def topic_labels(spark, d):
    """TXT20, AGG26."""
    return corpus_views.topic_labels(table(spark, d, "documents"), "lang", "text")


def _unescaped(sql: str) -> str:
    """Every named entity, and of the numeric ones that of the apostrophe, which is the one that pages hold."""
    for entity, char in [*((f"&{name};", char) for name, char in H.NAMED.items() if name != "amp"), ("&#39;", "'"), ("&amp;", "&")]:
        sql = f"replace({sql}, '{entity}', {literal(char)})"
    return sql


TEXT_SQL = "trim(regexp_replace(" + _unescaped(r"regexp_replace(regexp_replace({h}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@query("txt26_html_text", f"SELECT page_id, CAST(length({TEXT_SQL.format(h='html')}) AS BIGINT) AS chars, md5({TEXT_SQL.format(h='html')}) AS digest FROM pages")
def html_text(spark, d):
    t = H.to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("bigint").alias("chars"), F.md5(t.cast("binary")).alias("digest"))


TITLE_SQL = TEXT_SQL.format(h="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query("txt26_title", f"SELECT page_id, nullif({TITLE_SQL}, '') AS title FROM pages")
def title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


ARTICLE_SQL = TEXT_SQL.format(h="regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")
REST_SQL = TEXT_SQL.format(h="regexp_replace(html, '(?is)<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>|<aside[^>]*>.*?</aside>', ' ', 'g')")


@query("txt27_main_text", f"SELECT page_id, md5(CASE WHEN length({ARTICLE_SQL}) > 200 THEN {ARTICLE_SQL} WHEN length({REST_SQL}) > 200 THEN {REST_SQL} END) AS digest FROM pages")
def main_text(spark, d):
    """TXT27, FLT18."""
    return table(spark, d, "pages").select("page_id", F.md5(H.main_text(F.col("html")).cast("binary")).alias("digest"))


@query("txt15_strip_fragment", "SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS url FROM pages")
def strip_fragment(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_fragment(F.col("url")).alias("url"))


def _article_sql() -> str:
    plain = "regexp_replace(coalesce(html, ''), '(?is)" + "|".join(rf"<{e}\b[^>]*>.*?</{e}>" for e in H.BOILERPLATE) + "', ' ', 'g')"
    links = r"array_to_string(regexp_extract_all(b, '(?is)<a\b[^>]*>(.*?)</a>', 1), ' ')"
    blocks = rf"regexp_extract_all({plain}, '(?is)<{H.BLOCKS}\b[^>]*>(.*?)</{H.BLOCKS}>', 1)"
    return f"""
        WITH b AS (SELECT page_id, unnest({blocks}) AS b, generate_subscripts({blocks}, 1) AS i FROM pages),
        t AS (SELECT page_id, i, {TEXT_SQL.format(h="b")} AS text, length({TEXT_SQL.format(h=links)}) AS linked FROM b),
        a AS (SELECT page_id, string_agg(text, ' ' ORDER BY i) AS inside FROM t WHERE length(text) > 0 AND linked * 2 <= length(text) GROUP BY page_id),
        p AS (SELECT page_id, coalesce(inside, '') AS inside, {TEXT_SQL.format(h="coalesce(html, '')")} AS page FROM pages LEFT JOIN a USING (page_id))
        SELECT page_id, CASE WHEN length(inside) > 200 THEN 'blocks' WHEN length(page) > 200 THEN 'page' END AS method, md5(CASE WHEN length(inside) > 200 THEN inside WHEN length(page) > 200 THEN page END) AS digest FROM p"""


@query("txt27_article_text", _article_sql())
def article_text(spark, d):
    """TXT27 by blocks that aren't mostly links."""
    x = table(spark, d, "pages").select("page_id", H.article_text(F.col("html")).alias("a"))
    return x.select("page_id", F.col("a.method").alias("method"), F.md5(F.col("a.text").cast("binary")).alias("digest"))


@query("txt28_published", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2020-01-02' WHEN 1 THEN '2021-02-03' WHEN 2 THEN '2022-03-04' END AS raw, CASE page_id % 4 WHEN 0 THEN 'jsonld:datePublished/dateCreated' WHEN 1 THEN 'meta:article:published_time' WHEN 2 THEN 'time:datetime' END AS source FROM pages")
def published(spark, d):
    """Each page with one of the places of a date, or none, put in front."""
    marks = ['<script type="application/ld+json">{"@type": "A", "datePublished": "2020-01-02"}</script>', '<meta property="article:published_time" content="2021-02-03">', '<time datetime="2022-03-04">then</time>', ""]
    put = F.element_at(F.array(*[F.lit(m) for m in marks]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    p = H.published(F.concat(put, F.col("html")))
    return table(spark, d, "pages").select("page_id", p["raw"].alias("raw"), p["source"].alias("source"))


@query("dom21_ingest", f"""
    WITH p AS (SELECT regexp_replace(trim(url), '#.*$', '') AS original_url, url, html FROM pages WHERE starts_with(url, 'http')), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_url ORDER BY url) AS r FROM p) WHERE r = 1),
    x AS (SELECT original_url, length({ARTICLE_SQL}) > 200 OR length({REST_SQL}) > 200 AS ok FROM k)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN ok THEN 'success' ELSE 'no_text' END AS status FROM x) GROUP BY status""")
def ingest(spark, d):
    """DOM21, AGG27."""
    return corpus_views.ingest(table(spark, d, "pages"), prefix="http").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("dom20_nearest_topic", """
    WITH c AS (SELECT label AS topic_id, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY label),
    d AS (SELECT vec_id, topic_id, list_distance(embedding::DOUBLE[], c::DOUBLE[]) AS distance FROM embeddings, c)
    SELECT vec_id, CASE WHEN distance > 1.0 THEN -1 ELSE topic_id END AS topic_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic_id) AS r FROM d) WHERE r = 1""")
def nearest_topic(spark, d):
    e = table(spark, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy(F.col("label").alias("topic_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    x = corpus_views.nearest_topic(e, c, "vec_id", "embedding", 1.0)
    return x.select("vec_id", "topic_id", F.round("distance", 6).alias("distance"))


@query("dom20_density_topics", """
    WITH RECURSIVE p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE embedding IS NOT NULL),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02),
    core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4),
    links AS (SELECT n.a, n.b FROM near n WHERE n.a IN (SELECT a FROM core) AND n.b IN (SELECT a FROM core)),
    reach AS (SELECT a AS node, a AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
    rooted AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node),
    found AS (SELECT node AS vec_id, cluster FROM rooted UNION ALL SELECT n.a, min(r.cluster) FROM near n JOIN rooted r ON n.b = r.node WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a),
    ranked AS (SELECT cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS INTEGER) AS topic_id FROM found GROUP BY cluster)
    SELECT vec_id, coalesce(topic_id, -1) AS topic_id FROM p LEFT JOIN found USING (vec_id) LEFT JOIN ranked USING (cluster)""")
def density_topics(spark, d):
    """DOM20 with outliers, TOP03: over two dimensions of the vectors, which SQL can follow; density_topics() reduces them first."""
    from presslens.operators.density import density_clusters

    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.slice("embedding", 1, 2).alias("v"))
    return corpus_views.numbered_topics(density_clusters(e, "vec_id", "v", 2, 0.02, 4), "vec_id")


@query("dom20_fit_topics")
def fit_topics(spark, d):
    return corpus_views.fit_topics(table(spark, d, "embeddings"), "embedding").select("vec_id", "topic_id")


@query("dom23_labelling_sheet", f"WITH {sentences_sql()}, k AS (SELECT doc_id, sent_id, sentence, doc_id || ':' || sent_id AS key FROM sentences), s AS (SELECT * FROM k ORDER BY md5('42|' || key), key LIMIT 100) SELECT 'article_' || row_number() OVER (ORDER BY doc_id, sent_id) AS index, sentence AS text, 0 AS label FROM s")
def labelling_sheet(spark, d):
    """DOM23, WIN08, SNK06's rows."""
    return corpus_views.labelling_sheet(table(spark, d, "documents"), "text", "doc_id", 100)


@query("agg22_named_gender")
def named_gender(spark, d):
    """AGG22, WIN16, over the rule-based annotator's people."""
    from presslens.plans.annotate import people

    first = constant(spark, [("The", "male"), ("Of", "mostly_female"), ("Orre", "female")], "first, gender")
    return corpus_views.named_gender(people(table(spark, d, "documents")), first)


@query("txt23_pair_text", "SELECT doc_id, md5('[TEXT] ' || text || ' [CAUSE] ' || source || ' [/CAUSE] [EFFECT] ' || lang || ' [/EFFECT]') AS digest FROM documents")
def pair_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.pair_text(F.col("text"), F.col("source"), F.col("lang")).cast("binary")).alias("digest"))
