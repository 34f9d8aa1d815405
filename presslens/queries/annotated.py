"""Queries over annotations given as rows: personas, snippets, causal edges, the gazetteer; and streams."""

from pyspark.sql import functions as F

from presslens.functions import text as T
from presslens.operators import joins as J
from presslens.operators.sampling import AT_MOST
from presslens.plans import annotate, causal, gazetteer, personas, snippets
from presslens.queries import constant, named, query, spread, spread_sql, table

LEXICON = [("click", 1.0, -1.0), ("view", -1.0, 1.0), ("purchase", 0.0, 0.0), ("error", -1.0, 0.0)]
ARGS_SQL = f"""{named(LEXICON, "lex", "verb, agent, theme")}, a AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS doc_id, 'p' || user_id AS persona, CASE WHEN event_id % 2 = 0 THEN 'nsubj' ELSE 'dobj' END AS role, event_type AS verb, count(*) AS cnt FROM events GROUP BY ALL),
    s AS (SELECT a.*, CASE WHEN role = 'nsubj' THEN agent ELSE theme END AS score FROM a JOIN lex USING (verb))"""


def _scorer(spark, d):
    """events as verb arguments: a user does or suffers an event's type on a day."""
    e = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("doc_id"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("persona"), F.when(F.col("event_id") % 2 == 0, "nsubj").otherwise("dobj").alias("role"), F.col("event_type").alias("verb"))
    lex = personas.lexicon(constant(spark, LEXICON, "verb, agent, theme", "string, double, double"), "verb", "agent", "theme")
    return personas.PersonaScorer(personas.verb_args(e), lex)


@query("agg17_persona_scores", f"WITH {ARGS_SQL}, n AS (SELECT persona, sum(cnt) AS n FROM a GROUP BY 1) SELECT persona, round(sum(cnt * score) / max(n), 6) AS score, count(*) AS match_count FROM s JOIN n USING (persona) GROUP BY persona HAVING count(*) >= 20")
def persona_scores(spark, d):
    """AGG17, FLT13, JON06, DOM10."""
    return _scorer(spark, d).totals(20).select("persona", F.round("score", 6).alias("score"), "match_count")


@query("agg18_document_scores", f"WITH {ARGS_SQL}, n AS (SELECT doc_id, persona, sum(cnt) AS n FROM a GROUP BY 1, 2), k AS (SELECT persona FROM s GROUP BY 1 HAVING count(*) >= 20) SELECT doc_id, persona, round(sum(cnt * score) / max(n), 6) AS score, count(*) AS scored_verbs FROM s JOIN n USING (doc_id, persona) WHERE persona IN (SELECT persona FROM k) GROUP BY 1, 2")
def document_scores(spark, d):
    return _scorer(spark, d).by_document(20).select("doc_id", "persona", F.round("score", 6).alias("score"), "scored_verbs")


@query("agg19_polarity", f"WITH {ARGS_SQL} SELECT persona, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS sign, verb || '_' || role AS verb_role, count(*) AS n FROM s WHERE score <> 0 GROUP BY ALL")
def polarity(spark, d):
    return _scorer(spark, d).polarity()


@query("map03_polarity_map", f"WITH {ARGS_SQL}, p AS (SELECT persona, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS sign, verb || '_' || role AS v, count(*) AS n FROM s WHERE score <> 0 GROUP BY ALL) SELECT persona, sign, string_agg(v || '=' || n, ',' ORDER BY v) AS verbs FROM p GROUP BY ALL")
def polarity_map(spark, d):
    x = _scorer(spark, d).polarity_map()
    return x.select("persona", "sign", F.array_join(F.transform(F.map_entries("verbs"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("verbs"))


@query("agg20_mention_counts", f"WITH {ARGS_SQL} SELECT persona, persona AS surface, sum(cnt)::BIGINT AS n FROM a GROUP BY persona")
def mention_counts(spark, d):
    return _scorer(spark, d).persona_cluster()


@query("agg25_verb_coverage", f"WITH {ARGS_SQL} SELECT verb, count(*) AS n FROM s GROUP BY verb")
def verb_coverage(spark, d):
    return _scorer(spark, d).verb_coverage()


@query("top04_top_personas", f"WITH {ARGS_SQL}, n AS (SELECT persona, sum(cnt) AS n FROM a GROUP BY 1), t AS (SELECT persona, sum(cnt * score) / max(n) AS score FROM s JOIN n USING (persona) GROUP BY persona) (SELECT persona, round(score, 6) AS score FROM t ORDER BY t.score DESC, persona LIMIT 5) UNION ALL (SELECT persona, round(score, 6) AS score FROM t ORDER BY t.score, persona LIMIT 5)")
def top_personas(spark, d):
    s = _scorer(spark, d)
    return s.top_personas(5).unionByName(s.top_personas(-5)).select("persona", F.round("score", 6).alias("score"))


@query("top05_top_verbs", f"WITH {ARGS_SQL}, p AS (SELECT persona, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS sign, verb || '_' || role AS verb_role, count(*) AS n FROM s WHERE score <> 0 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY persona, sign ORDER BY n DESC, verb_role DESC) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 2")
def top_verbs(spark, d):
    return _scorer(spark, d).top_verbs(2)


@query("set06_documents_of", f"WITH {ARGS_SQL} SELECT doc_id, 'verb' AS kind FROM a WHERE verb = 'click' GROUP BY 1 UNION ALL SELECT doc_id, 'persona' FROM s WHERE persona = 'p1' GROUP BY 1")
def documents_of(spark, d):
    """DOM24, SET06."""
    s = _scorer(spark, d)
    return s.documents_with_verb("CLICK").withColumn("kind", F.lit("verb")).unionByName(s.documents_with_persona("P1").withColumn("kind", F.lit("persona")))


@query("agg21_bootstrap", f"""
    WITH {ARGS_SQL}, draws AS (SELECT b, doc_id, CAST(('0x' || substr(md5('0|' || b || '|' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / {float(16**13)!r} AS u FROM (SELECT DISTINCT doc_id FROM a), (SELECT unnest(range(20)) AS b)),
    t AS (SELECT b, doc_id, len(list_filter({AT_MOST!r}::DOUBLE[], lambda x: u >= x)) AS t FROM draws WHERE u >= {AT_MOST[0]!r}),
    one AS (SELECT doc_id, persona, n, sc FROM (SELECT doc_id, persona, sum(cnt) AS n FROM a GROUP BY 1, 2) LEFT JOIN (SELECT doc_id, persona, sum(cnt * score) AS sc FROM s GROUP BY 1, 2) USING (doc_id, persona)),
    r AS (SELECT b, persona, sum(t * sc) / sum(t * n) AS score FROM t JOIN one USING (doc_id) GROUP BY 1, 2 HAVING sum(t * sc) IS NOT NULL)
    SELECT persona, round(avg(score), 6) AS score, round(stddev_pop(score), 6) AS sd, count(*) AS replicates FROM r GROUP BY persona""")
def bootstrap(spark, d):
    x = _scorer(spark, d).bootstrap(20)
    return x.select("persona", F.round("score", 6).alias("score"), F.round("sd", 6).alias("sd"), "replicates")


EVENTS = {"of": "events", "key": "event_id"}
LABELLED = [(0, "have{s}", "power_agent", "agency_pos", 0), (0, "beg", "power_theme", "agency_neg", 1), (0, "see{s}", None, "agency_equal", 2), (0, "beg", "power_agent", None, 3), (1, "have{s}", "power_theme", "agency_pos", 0)]
LABELLED_NAMES, LABELLED_KINDS = "verb, power, agency, seq", "string, string, string, int"


@query("dom10_label_lexicon", f"""
    WITH {spread_sql("l", LABELLED, LABELLED_NAMES, LABELLED_KINDS)}, u AS (SELECT DISTINCT verb, power, c_custkey * 10 + seq AS seq FROM l WHERE power IN ('power_agent', 'power_theme')),
    one AS (SELECT verb, arg_max(power, seq) AS power FROM u GROUP BY verb)
    SELECT verb, CASE power WHEN 'power_agent' THEN 1.0 ELSE -1.0 END::DOUBLE AS agent, CASE power WHEN 'power_agent' THEN -1.0 ELSE 1.0 END::DOUBLE AS theme FROM one""")
def label_lexicon(spark, d):
    """Of a verb that repeats the last label counts; a label of neither side gives no row."""
    x = spread(spark, d, LABELLED, LABELLED_NAMES, LABELLED_KINDS)
    return personas.label_lexicon(x.withColumn("seq", F.col("c_custkey") * 10 + F.col("seq")).where("power IS NOT NULL"), "power", "seq")


CHUNKS = [(0, 0, 1, "He", 0, "nsubj", "PRON", "abandon"), (0, 3, 5, "the doctor{s}", 4, "dobj", "NOUN", "abandon"), (0, 7, 8, "who", 7, "nsubj", "PRON", "see"), (1, 0, 2, "My Mother{s}", 1, "nsubj", "NOUN", "see{s}"), (1, 4, 5, "him", 4, "dobj", "PRON", "see"), (1, 9, 10, "it", 9, "pobj", "PRON", "of")]
CHUNK_NAMES, CHUNK_KINDS = "start, end, text, root_i, root_dep, root_pos, head_lemma", "int, int, string, int, string, string, string"
COREF = [(0, 0, 0, 0, 1, "He", 0, "nsubj", "he", "abandon"), (0, 0, 1, 7, 8, "who", 0, "nsubj", "who", "see"), (1, 1, 0, 4, 5, "him", 0, "dobj", "him", "see"), (1, 1, 1, 6, 7, "his", 1, "poss", "his", "dog")]
COREF_NAMES, COREF_KINDS = "cluster_id, mention_id, start, end, text, sent_id, root_dep, root_lemma, head_lemma", "int, int, int, int, string, int, string, string, string"
PATTERNS = [("man", "^he$|^him$"), ("doctor", "doctor")]
CHUNKS_SQL, COREF_SQL = spread_sql("c", CHUNKS, CHUNK_NAMES, CHUNK_KINDS, **EVENTS), spread_sql("r", COREF, COREF_NAMES, COREF_KINDS, **EVENTS)


def _chunks(spark, d):
    return spread(spark, d, CHUNKS, CHUNK_NAMES, CHUNK_KINDS, **EVENTS).withColumnRenamed("event_id", "doc_id")


def _coref(spark, d):
    return spread(spark, d, COREF, COREF_NAMES, COREF_KINDS, **EVENTS).withColumnRenamed("event_id", "doc_id")


@query("jon11_pattern_events", f"""WITH {CHUNKS_SQL}, {named(PATTERNS, "p", "persona, pattern")} SELECT event_id AS doc_id, persona, root_dep AS role, lower(head_lemma) AS verb, lower(text) AS surface FROM c, p WHERE root_dep IN ('nsubj', 'dobj') AND regexp_matches(lower(text), pattern)""")
def pattern_events(spark, d):
    """DOM08, JON11, ARR05, over the chunks of all events."""
    return personas.pattern_events(_chunks(spark, d), constant(spark, PATTERNS, "persona, pattern"))


PEOPLE_WORDS = ["doctor", "who", "mothera"]


@query("dom08_people_words", f"""WITH {CHUNKS_SQL}, {named([(w,) for w in PEOPLE_WORDS], "w", "word")} SELECT event_id AS doc_id, word AS persona, root_dep AS role, lower(head_lemma) AS verb, lower(text) AS surface FROM c, w WHERE root_dep IN ('nsubj', 'dobj') AND list_contains(string_split(lower(text), ' '), word)""")
def people_words(spark, d):
    """DOM08 with a list of words for people, some of them set, some added."""
    words = personas.PeopleWords().set(PEOPLE_WORDS[:2]).add(PEOPLE_WORDS[2:])
    return personas.people_word_events(_chunks(spark, d), words.relation(spark))


@query("jon13_without_overlap", f"""WITH {CHUNKS_SQL}, {COREF_SQL} SELECT event_id AS doc_id, text FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.event_id = c.event_id AND greatest(c."start", r."start") <= least(c."end", r."end"))""")
def without_overlap(spark, d):
    return J.without_overlap(_chunks(spark, d), _coref(spark, d)).select("doc_id", "text")


DISCOVERED = [(0, "he", "nsubj", "abandon", "he"), (0, "he", "nsubj", "see", "who"), (0, "doctor{s}", "dobj", "abandon", "the doctor{s}"), (1, "he", "dobj", "see", "him"), (1, "he", None, None, "his"), (1, "mother{s}", "nsubj", "see{s}", "my mother{s}"), (1, "it", None, None, "it")]


@query("dom09_discovered_events", f"""WITH {spread_sql("x", DISCOVERED, "persona, role, verb, surface", "string, string, string, string", **EVENTS)} SELECT event_id AS doc_id, persona, role, verb, surface FROM x""")
def discovered_events(spark, d):
    """DOM09, TXT16, TXT17, FLT16."""
    return personas.discovered_events(_coref(spark, d), _chunks(spark, d))


SENTS = [(0, i, "S{s}%d." % i, 10 * i, 10 * i + 9) for i in range(4)] + [(1, i, "T{s}%d." % i, 10 * i, 10 * i + 9) for i in range(3)]
SNIPPETS = [(0, 1, "S{s}0. S{s}1."), (1, 1, "T{s}0. T{s}1."), (1, 2, "T{s}0. T{s}1. T{s}2.")]


@query("dom11_coref_snippets", f"""WITH {spread_sql("x", SNIPPETS, "snippet_index, snippet", "int, string", **EVENTS)} SELECT 'Him' AS person, event_id AS article_index, snippet_index, snippet, 'M' AS gender FROM x""")
def coref_snippets(spark, d):
    """DOM11, JON10, WIN10, JON05."""
    s = spread(spark, d, SENTS, "sent_id, text, char_start, char_end", "int, string, int, int", **EVENTS).withColumnRenamed("event_id", "doc_id")
    targets = constant(spark, [("Him", "^him$|^he$")], "person, pattern")
    return snippets.build(_coref(spark, d), s, targets, constant(spark, [("Him", "M")], "name, gender"))


TOKEN_NAMES, TOKEN_KINDS = "tok_i, sent_id, text, lower, lemma, pos, dep, head_i, char_start, char_end", "int, int, string, string, string, string, string, int, int, int"


def tokens_of(case: int, words: list[tuple[str, str, str, str, int]]) -> list[tuple]:
    """(text, lemma, pos, dep, head) rows as ann_token."""
    out, at = [], 0
    for i, (text, lemma, pos, dep, head) in enumerate(words):
        out.append((case, i, 0, text, text.lower(), lemma, pos, dep, head, at, at + len(text)))
        at += len(text) + 1
    return out


#: Sentences that state a cause, one for each family and case. In the last a word that holds to account is six steps below its verb.
CAUSAL_TOKENS = (
    tokens_of(0, [("Cuts{s}", "cut", "NOUN", "nsubj", 1), ("triggered", "trigger", "VERB", "ROOT", 1), ("backlash", "backlash", "NOUN", "dobj", 1)])
    + tokens_of(1, [("Cuts", "cut", "NOUN", "nsubj", 1), ("led", "lead", "VERB", "ROOT", 1), ("to", "to", "ADP", "prep", 1), ("crisis{s}", "crisis", "NOUN", "pobj", 2)])
    + tokens_of(2, [("Cuts", "cut", "NOUN", "nsubj", 1), ("led", "lead", "VERB", "ROOT", 1), ("with", "with", "ADP", "prep", 1), ("crisis", "crisis", "NOUN", "pobj", 2)])
    + tokens_of(3, [("Defeat", "defeat", "NOUN", "nsubj:pass", 2), ("was", "be", "AUX", "auxpass", 2), ("caused", "cause", "VERB", "ROOT", 2), ("by", "by", "ADP", "prep", 2), ("division{s}", "division", "NOUN", "pobj", 3)])
    + tokens_of(4, [("They", "they", "PRON", "nsubj", 1), ("caused", "cause", "VERB", "ROOT", 1), ("crisis", "crisis", "NOUN", "dobj", 1)])
    + tokens_of(5, [("Delay", "delay", "NOUN", "ROOT", 0), ("because", "because", "SCONJ", "prep", 0), ("of", "of", "ADP", "pcomp", 1), ("Smith{s}", "smith", "PROPN", "pobj", 1)])
    + tokens_of(6, [("He", "he", "PRON", "nsubj", 1), ("blamed", "blame", "VERB", "ROOT", 1), ("Smith{s}", "smith", "PROPN", "dobj", 1), ("for", "for", "ADP", "prep", 1), ("collapse", "collapse", "NOUN", "pobj", 3)])
    + tokens_of(7, [("He", "he", "PRON", "nsubj", 1), ("held", "hold", "VERB", "ROOT", 1), ("Smith", "smith", "PROPN", "dobj", 1), ("for", "for", "ADP", "prep", 1), ("collapse", "collapse", "NOUN", "pobj", 3)])
    + tokens_of(8, [("He", "he", "PRON", "nsubj", 1), ("held", "hold", "VERB", "ROOT", 1), ("Smith{s}", "smith", "PROPN", "dobj", 1), ("responsible", "responsible", "ADJ", "oprd", 1), ("for", "for", "ADP", "prep", 1), ("collapse", "collapse", "NOUN", "pobj", 4)])
    + tokens_of(9, [("She", "she", "PRON", "nsubj", 1), ("caused", "cause", "VERB", "ROOT", 1), ("weather", "weather", "NOUN", "dobj", 1)])
    + tokens_of(10, [("He", "he", "PRON", "nsubj", 1), ("held", "hold", "VERB", "ROOT", 1), ("Smith{s}", "smith", "PROPN", "dobj", 1), ("for", "for", "ADP", "prep", 1), ("collapse", "collapse", "NOUN", "pobj", 3), *[("so", "so", "ADV", "advmod", h) for h in (1, 5, 6, 7, 8)], ("accountable", "accountable", "ADJ", "acomp", 9)])
)
CAUSAL_CHUNKS = [(c, i, i + 1, t, i, dep, pos, "x") for c, i, _, t, _, _, pos, dep, *_ in CAUSAL_TOKENS if pos in ("NOUN", "PROPN", "PRON")]
EDGES = [
    (0, "CAUSED", "Cuts{s}", "backlash", 0.75, "causative_verb:trigger"), (1, "CAUSED", "Cuts", "crisis{s}", 0.65, "causative_verb:lead"), (3, "CAUSED", "division{s}", "Defeat", 0.75, "passive_causative_verb:cause"), (3, "CAUSED", "Defeat", "division{s}", 0.75, "causative_verb:cause"),
    (5, "CAUSAL_PREP", "Smith{s}", "Delay", 0.6, "marker:because_of"), (6, "RESPONSIBLE_FOR", "Smith{s}", "collapse", 0.75, "attrib_verb:blame"), (8, "RESPONSIBLE_FOR", "Smith{s}", "collapse", 0.75, "attrib_verb:hold"), (10, "RESPONSIBLE_FOR", "Smith{s}", "collapse", 0.75, "attrib_verb:hold"),
]
EDGES_SQL = spread_sql("x", EDGES, "relation, cause, effect, confidence, evidence", "string, string, string, double, string", **EVENTS)


def causal_edges_of(spark, d):
    tokens = spread(spark, d, CAUSAL_TOKENS, TOKEN_NAMES, TOKEN_KINDS, **EVENTS).withColumnRenamed("event_id", "doc_id")
    chunks = spread(spark, d, CAUSAL_CHUNKS, CHUNK_NAMES, CHUNK_KINDS, **EVENTS).withColumnRenamed("event_id", "doc_id")
    none = spark.createDataFrame([], "doc_id bigint, start int, end int, text string, label string")
    owners = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("person"), F.col("event_id").alias("article_index"), F.lit(1).alias("snippet_index"))
    return causal.edges(tokens, causal.candidates(tokens, none, chunks), owners)


@query("dom13_causal_edges", f"WITH {EDGES_SQL} SELECT event_id AS article_index, 'p' || user_id AS person, relation, cause, effect, confidence, evidence FROM x JOIN events USING (event_id)")
def causal_edges(spark, d):
    """DOM13 to DOM16, DOM13a, JON14, WIN13, TXT18, over the tokens and chunks of all events."""
    return causal_edges_of(spark, d).select("article_index", "person", "relation", "cause", "effect", "confidence", "evidence")


@query("dom17_rescored_edges", f"WITH {EDGES_SQL} SELECT event_id AS article_index, evidence || '|clf' AS evidence, confidence * (CASE WHEN length(effect) > 8 THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence FROM x WHERE confidence * (CASE WHEN length(effect) > 8 THEN 0.5 ELSE 0.9 END)::DOUBLE >= 0.3")
def rescored_edges(spark, d):
    """A classifier is called with batches of marked pairs of cause and effect; this one goes by the length of the effect."""
    def classify(texts):
        return [0.5 if len(t.split("[EFFECT] ")[1].split(" [/EFFECT]")[0]) > 8 else 0.9 for t in texts]

    found = causal_edges_of(spark, d).withColumn("text", F.concat_ws(" ", "cause", "effect"))
    return causal.rescore(found, causal.classified(classify, F.col("text"), F.col("cause"), F.col("effect")), 0.3).select("article_index", "evidence", "confidence")


#: Texts for the rule-based annotator, and the edges that are found in what it makes of them.
STATED = [(0, "The Cuts{s} triggered a backlash."), (1, "Cuts{s} led to a crisis."), (2, "Nothing happened here."), (3, "Delay because of Smith{s}."), (4, "The vote{s} resulted in a victory. It rained."), (5, None)]
STATED_EDGES = [(0, "CAUSED", "The Cuts{s}", "a backlash", 0.75, "causative_verb:trigger"), (1, "CAUSED", "Cuts{s}", "a crisis", 0.65, "causative_verb:lead"), (3, "CAUSAL_PREP", "Smith{s}", "Delay", 0.6, "marker:because_of"), (4, "CAUSED", "The vote{s}", "a victory", 0.65, "causative_verb:result"), (5, None, None, None, None, None)]


@query("annotated_corpus_edges", f"WITH {spread_sql('x', STATED_EDGES, 'relation, cause, effect, confidence, evidence', 'string, string, string, double, string', **EVENTS)} SELECT event_id AS article_index, relation, cause, effect, confidence, evidence FROM x WHERE relation IS NOT NULL")
def annotated_corpus_edges(spark, d):
    """The rule-based annotator and the causal families over a text for each event."""
    docs = spread(spark, d, STATED, "text", "string", **EVENTS).withColumnRenamed("event_id", "doc_id")
    a = annotate.annotate(docs)
    spans = causal.candidates(a["ann_token"], a["ann_entity"], a["ann_chunk"])
    owners = docs.select("doc_id", F.lit("all").alias("person"), F.col("doc_id").alias("article_index"), F.lit(1).alias("snippet_index"))
    return causal.edges(a["ann_token"], spans, owners).select("article_index", "relation", "cause", "effect", "confidence", "evidence")


MORAL_TOKENS = tokens_of(0, [("Kind", "kind", "ADJ", "amod", 1), ("Ann{s}", "ann", "PROPN", "nsubj", 2), ("protected", "protect", "VERB", "ROOT", 2), ("Bob{s}", "bob", "PROPN", "dobj", 2)]) + tokens_of(1, [("They", "they", "PRON", "nsubj", 1), ("betrayed", "betray", "VERB", "ROOT", 1), ("Ann{s}", "ann", "PROPN", "dobj", 1)])
MORAL_ENTITIES = [(0, 1, 2, "Ann{s}", "PERSON"), (0, 3, 4, "Bob{s}", "PERSON"), (1, 2, 3, "Ann{s}", "PERSON")]
MORAL_DICTIONARY = [("protect", "care.virtue"), ("kind", "care.virtue"), ("betray", "loyalty.vice"), ("protect", "authority.virtue")]
MORAL_FOUND = [(0, "Ann{s}", "agent", "care.virtue"), (0, "Ann{s}", "agent", "authority.virtue"), (0, "Ann{s}", "attribute", "care.virtue"), (0, "Bob{s}", "patient", "care.virtue"), (0, "Bob{s}", "patient", "authority.virtue"), (1, "Ann{s}", "patient", "loyalty.vice")]


@query("dom05c_entity_words", f"WITH {spread_sql('x', MORAL_FOUND, 'entity, role, category', 'string, string, string', **EVENTS)} SELECT event_id AS doc_id, entity, role, category, 1::BIGINT AS n FROM x")
def entity_words(spark, d):
    """DOM05c: moral verbs that people do and suffer, and their attributes."""
    from presslens.plans import frames

    tokens = spread(spark, d, MORAL_TOKENS, TOKEN_NAMES, TOKEN_KINDS, **EVENTS).withColumnRenamed("event_id", "doc_id")
    people = spread(spark, d, MORAL_ENTITIES, "start, end, text, label", "int, int, string, string", **EVENTS).withColumnRenamed("event_id", "doc_id")
    return frames.entity_words(tokens, people, constant(spark, MORAL_DICTIONARY, "word, category"))


IN_SENTENCES = [(0, 0, 0, "S{s}0. "), (0, 4, 0, "S{s}0. "), (0, 10, 1, "S{s}1."), (0, 15, 1, "S{s}1."), (1, 29, 2, "T{s}2."), (1, 40, None, None)]
STARTS = [(c, at) for c, at, _, _ in IN_SENTENCES]


@query("jon15_sentence_of", f"""WITH {spread_sql("x", [(c, at, i, t.strip() if t else None) for c, at, i, t in IN_SENTENCES], "char_start, sent_id, sentence", "int, int, string", **EVENTS)} SELECT event_id AS doc_id, char_start, sent_id FROM x WHERE sent_id IS NOT NULL""")
def sentence_of(spark, d):
    """JON15: tokens by the sentence that holds their first character; a token outside all has none and goes."""
    s = spread(spark, d, [(c, i, a, b + 1) for c, i, _, a, b in SENTS], "sent_id, char_start, char_end", "int, int, int", **EVENTS).withColumnRenamed("event_id", "doc_id")
    t = spread(spark, d, STARTS, "char_start", "int", **EVENTS).withColumnRenamed("event_id", "doc_id")
    return J.sentence_of(t, s).select("doc_id", "char_start", "sent_id")


@query("agg26_topic_info", "SELECT source AS topic_id, count(*) AS n FROM documents GROUP BY source")
def topic_info(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))


NAME_CASES = [(0, "Rt Hon Sir Keir Starmer{s} KC MP"), (1, "Dr. Jane van Roe{s}, OBE"), (2, "Baroness May{s} of Maidenhead"), (3, "Lord Mandelson{s}"), (4, "Aberdare{s}"), (5, "Diane Abbott{s}")]
NAMES_TOLD = [(0, "Keir Starmer{s}", False, "Keir Starmer{s}"), (1, "Jane van Roe{s}", False, "Jane Roe{s}"), (2, "May{s} of Maidenhead", True, "May{s} Maidenhead"), (3, "Mandelson{s}", True, "Mandelson{s}"), (4, "Aberdare{s}", True, "Aberdare{s}"), (5, "Diane Abbott{s}", False, "Diane Abbott{s}")]


@query("txt12_normal_names", f"WITH {spread_sql('x', NAMES_TOLD, 'normal, titled, short', 'string, boolean, string')} SELECT * FROM x")
def normal_names(spark, d):
    """TXT12, TXT14, FLT17, over a name for each customer."""
    n = T.normal_name(F.col("name"))
    return spread(spark, d, NAME_CASES, "name", "string").select("c_custkey", n.alias("normal"), T.peerage(F.col("name"), F.lit("")).alias("titled"), T.first_last(n).alias("short"))


BIOS = [(0, "Her name is Theresa Mary May{s}."), (1, "She was MP for Maidenhead{s} (1997-2024)."), (2, "elected as MP for X in 2001, born Of The Sea{s}"), (3, None), (4, "His name is Sean&#32;Doe{s} &amp; so on."), (5, "Her name is Zoe&nbsp;M&#x69;ller{s}.")]
BIOS_TOLD = [(0, "Theresa Mary May{s}", None, None), (1, None, "1997-01-01", "2024-12-31"), (2, None, "2001-01-01", ""), (3, None, None, None), (4, "Sean Doe{s}", None, None), (5, "Zoe Miller{s}", None, None)]


@query("txt10_bio_names", f"WITH {spread_sql('x', BIOS_TOLD, 'name, start, stop', 'string, string, string')} SELECT * FROM x")
def bio_names(spark, d):
    """TXT10, TXT11; entities are unescaped first."""
    y = T.served_years(F.col("s"))
    return spread(spark, d, BIOS, "s", "string").select("c_custkey", T.name_from_bio(F.col("s")).alias("name"), y["start"].alias("start"), y["end"].alias("stop"))


@query("txt13_simple_names", f"""WITH {spread_sql('x', [(0, "Rees-Mogg{s} O'Neil"), (1, "Cameron{s}")], 'simple', 'string')} SELECT * FROM x""")
def simple_names(spark, d):
    return spread(spark, d, [(0, "Mr rees-mogg{s} o'neil"), (1, "Lord Cameron{s} of Lapworth")], "name", "string").select("c_custkey", T.simple_name(F.col("name")).alias("simple"))


@query("txt19_flexible_pattern", r"SELECT p_partkey, regexp_matches(p_name || '  x', '(?i)(small\s+ring|small\s+nut|small)\b') AS hit FROM part")
def flexible(spark, d):
    """TXT19, SRT04: any of the names, the longest first."""
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("  x")).rlike("(?i)(" + T.flexible_pattern(["small", "small nut", "small ring"]) + r")\b").alias("hit"))


ALIASES = [(0, "boris johnson{s}", "<boris_johnson{s}>"), (0, "johnson{s}", "<boris_johnson{s}>"), (0, "bojo", "<boris_johnson{s}>"), (1, "theresa mary may{s}", "<theresa_mary_may{s}>"), (1, "theresa may{s}", "<theresa_mary_may{s}>"), (1, "may{s}", "<theresa_mary_may{s}>")]


@query("arr03_aliases", f"""WITH {spread_sql('x', ALIASES, 'alias, tag', 'string, string')}, one AS (SELECT DISTINCT alias, tag FROM x) SELECT alias, min(tag) AS tag FROM one GROUP BY alias""")
def alias_rows(spark, d):
    """ARR03, FLT15, Q9's precedence: of people with one alias the first by name has it."""
    g = spread(spark, d, [(0, "Boris Johnson{s}", "BoJo; "), (1, "Theresa Mary May{s}", None)], "name_final, aliases", "string, string").drop("c_custkey").distinct()
    return gazetteer.name_table(gazetteer.aliases(g, extra="aliases"))


MEMBER_NAMES, MEMBER_KINDS = "n, display, full_title, gender, party, house, constituency, start, end", "int, string, string, string, string, int, string, string, string"
COMMONS = [(0, 1, "Ms Ann Mary Roe{s}", "Ann Roe MP", "F", "A", 1, "X", "2001-05-01", None), (0, 1, "Ms Ann Mary Roe{s}", "Ann Roe MP", "F", "A", 1, "Y", "2010-05-01", None), (0, 2, "Mr Old", "Mr Old", "M", "B", 1, "Z", "1950-01-01", "1960-01-01")]
LORDS = [(0, 3, "Lord Fox{s}", "The Lord Fox", "M", "C", 2, "Life", None, None), (0, 4, "Lord Gone", "", "M", "C", 2, "Life", None, None), (0, 5, "Lord Prose{s}", "", "M", "C", 2, "Life", None, None)]
FOUND = [(0, 1, "Ann Roe{s}", "normalized", "Y", "2010-05-01"), (0, 3, "Robin Fox{s}", "synopsis", "Life", "1992-01-01"), (0, 5, "Prose{s}", "unresolved", "Life", "1997-01-01")]


def _member(df):
    return df.withColumn("id", F.col("c_custkey") * 10 + F.col("n")).drop("c_custkey", "n")


@query("dom18_gazetteer", f"""WITH {spread_sql('x', FOUND, 'n, name_final, resolution_method, constituency, s', 'int, string, string, string, string')} SELECT c_custkey * 10 + n AS id, name_final, resolution_method, constituency, CAST(s AS DATE) AS membership_start, CAST(row_number() OVER (ORDER BY name_final, c_custkey * 10 + n) AS INTEGER) AS place FROM x""")
def gazetteer_rows(spark, d):
    """DOM18, DOM18b, JON09, FLT10, FLT11, SRT03: six members for each customer, two of them never within reach; sorted by name."""
    commons, lords = (_member(spread(spark, d, r, MEMBER_NAMES, MEMBER_KINDS)) for r in (COMMONS, LORDS))
    history = _member(spread(spark, d, [(0, 3, "1992-01-01", "1997-01-01"), (0, 4, None, None)], "n, start, end", "int, string, string"))
    prose = _member(spread(spark, d, [(0, 5, "was MP for Q from 1997 to 2001")], "n, text", "int, string"))
    texts = {"synopsis": _member(spread(spark, d, [(0, 3, "born Robin James Fox{s}")], "n, text", "int, string")), "career": _member(spread(spark, d, [(0, 3, "His name is Other Name")], "n, text", "int, string"))}
    return gazetteer.placed(gazetteer.build(commons, lords, history, texts, prose)).select("id", "name_final", "resolution_method", "constituency", "membership_start", "place")


@query("src12_sitemap", "SELECT page_id, k AS position, url || '/' || k AS location FROM pages, (VALUES (0), (1), (2)) AS t(k) WHERE url IS NOT NULL AND NOT contains(url, '&') AND NOT contains(url, '<')")
def sitemap(spark, d):
    """A sitemap of three addresses for each page."""
    from presslens.sources.web import sitemap_locations

    p = table(spark, d, "pages").where("url IS NOT NULL AND NOT contains(url, '&') AND NOT contains(url, '<')")
    locations = F.array_join(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("/"), k.cast("string"), F.lit("</loc></url>"))), "")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locations, F.lit("</urlset>"))
    return sitemap_locations(p.select("page_id", xml.alias("xml"))).select("page_id", "position", "location")


@query("src13_captures", "SELECT t.timestamp, CAST(user_id AS VARCHAR) AS original, t.digest FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('2001', 'd1'), ('2003', 'd2'), ('2006', 'd1')) AS t(timestamp, digest)")
def captures(spark, d):
    """SRC13, MAP02: a listing for each user, with a repeat of a digest, one that comes back, and a failed capture."""
    from presslens.sources.web import captures as run

    u = F.col("user_id").cast("string")
    rows = [("2001", "200", "d1"), ("2002", "200", "d1"), ("2003", "200", "d2"), ("2004", "404", "d3"), ("2006", "200", "d1")]
    text = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    body = F.to_json(F.array(text("timestamp", "original", "statuscode", "mimetype", "digest", "length"), *[text(t, u, code, "t", digest, "1") for t, code, digest in rows]))
    return run(table(spark, d, "events").select("user_id").distinct().select(body.alias("body"))).select("timestamp", "original", "digest")


@query("src10_api_members", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS display, c_mktsegment AS party, '2001-02-03' AS start FROM customer")
def api_members(spark, d):
    """Pages of members, one for each nation, by landed responses that name the total; all pages together have it."""
    from presslens.sources.web import api_members as run, complete_pages

    value = F.struct(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("nameDisplayAs"), F.struct(F.col("c_mktsegment").alias("name")).alias("latestParty"), F.struct(F.lit(1).alias("house"), F.lit("2001-02-03T00:00:00").alias("membershipStartDate")).alias("latestHouseMembership")).alias("value"))
    c = table(spark, d, "customer")
    pages = c.groupBy("c_nationkey").agg(F.collect_list(value).alias("items")).select(F.to_json(F.struct("items", F.lit(c.count()).alias("totalResults"))).alias("body"))
    return run(complete_pages(pages)).select("id", "display", "party", "start")


BULK = [
    (0, '{"Members": {"Member": [{"@Member_Id": "%", "StartDate": "2001-01-02T00:00:00", "EndDate": {"@xsi:nil": "true"}}]}}', "2001-01-02", None),
    (1, '{"Members": {"Member": {"@Member_Id": "%", "StartDate": "1999-05-06", "EndDate": {"#text": "2003-04-05T00:00:00"}}}}', "1999-05-06", "2003-04-05"),
    (2, '<?xml version="1.0"?><Members xmlns="http://a/b"><Member Member_Id="%"><HouseMemberships><HouseMembership><House>Commons</House><StartDate>1997-01-01T00:00:00</StartDate><EndDate></EndDate></HouseMembership><HouseMembership><House>Lords</House><StartDate>2010-01-01T00:00:00</StartDate></HouseMembership></HouseMemberships></Member></Members>', "1997-01-01", None),
    (3, '{"Members": {"Member": {"@Member_Id": "%", "HouseMemberships": {"HouseMembership": [{"House": {"#text": "Commons"}, "StartDate": "1990-01-01", "EndDate": "1995-01-01"}, {"House": "House of Commons", "StartDate": "1996-01-01", "EndDate": "1999-01-01"}, {"House": "Lords", "StartDate": "2005-01-01"}]}}}}', "1996-01-01", "1999-01-01"),
]


@query("src11_bulk_memberships", f"WITH {spread_sql('x', [(c, a, b) for c, _, a, b in BULK], 'start, end', 'string, string')} SELECT * FROM x".replace("SELECT * FROM x", "SELECT c_custkey AS id, \"start\", \"end\" FROM x"))
def bulk(spark, d):
    """Lists, single members, and XML where the service gave that; a byte order mark before some."""
    from presslens.sources.web import bulk_memberships

    x = spread(spark, d, [(c, text) for c, text, _, _ in BULK], "body", "string")
    body = F.replace("body", F.lit("%"), F.col("c_custkey").cast("string"))
    return bulk_memberships(x.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("﻿"), body)).otherwise(body).alias("body")))


@query("src14_listed_urls", "SELECT url, min(ts) AS ts FROM (SELECT regexp_replace(url, '#.*$', '') AS url, CAST(2000 + page_id % 30 AS VARCHAR) AS ts FROM pages) WHERE starts_with(url, 'https') AND CAST(ts AS INTEGER) BETWEEN 2005 AND 2020 GROUP BY url ORDER BY url LIMIT 40")
def listed_urls(spark, d):
    from presslens.sources.web import listed_urls as run

    p = table(spark, d, "pages").select(T.strip_fragment(F.col("url")).alias("url"), (F.lit(2000) + F.col("page_id") % 30).cast("string").alias("ts"))
    return run(p, "https", 2005, 2020, 40, url="url", stamp="ts")


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, d):
    from presslens.streaming import streams

    return streams.read_stream(spark, f"{d}/events*.parquet", EVENT_SCHEMA)


@query("str03_running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d):
    from presslens.streaming import streams

    return streams.drain(streams.running_counts(_stream(spark, d), "event_type"), "complete")


@query("str05_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    from presslens.streaming import streams

    x = streams.drain(streams.windowed_counts(_stream(spark, d), "ts", "1 day", "40 days", "event_type"), "complete")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("str02_first_seen", "SELECT count(DISTINCT user_id) AS users FROM events")
def stream_first_seen(spark, d):
    from presslens.streaming import streams

    return streams.drain(streams.first_seen(_stream(spark, d), "user_id", "ts", "60 days").select("user_id")).agg(F.count(F.lit(1)).alias("users"))
