"""Causal edges between nominal spans, from verbs, markers and attributions, over annotation relations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.functions.text import nominalisation, pair_text, squeeze
from presslens.operators.dedupe import best_edges, keep_first
from presslens.operators.joins import smallest_span

#: Verbs that cause by themselves, and those that do with a preposition (any complement for the last).
STRONG = ["cause", "trigger", "force", "prompt", "spark"]
WEAK = {"lead": ["to", "into"], "result": ["in", "into"], "bring": ["about"], "produce": []}
#: Verbs of attribution with the relation they state; hold needs one of the words after it.
ATTRIBUTION = {"blame": "RESPONSIBLE_FOR", "fault": "RESPONSIBLE_FOR", "hold": "RESPONSIBLE_FOR", "credit": "CREDITED_FOR", "praise": "CREDITED_FOR", "accuse": "ACCUSED_OF"}
HELD = ["responsible", "accountable", "culpable"]
#: Phrases before a cause.
MARKERS = ["because of", "due to", "as a result of"]
#: Heads that are no outcome, heads that are, and words that make an outcome of a phrase.
NO_EFFECT = "hair weather breakfast article office home area country government people day time year morning week month date thing way place".split()
EFFECTS = "crisis backlash failure resignation defeat surge shock impasse division victory condemnation collapse increase decline harm damage uproar anger wrath tremor warning assault attack debate referendum vote u-turn windfall legislation programme policy deal transition delay holdup problem issue".split()
EFFECT_WORDS = "crisis backlash failure resignation defeat surge shock impasse division victory condemnation".split()
#: The order in which labels of one span win.
PRIORITY = ["ANCHOR", "PERSON", "ORG", "GPE", "NOMINALIZATION", "NP"]
OBJECTS, SUBJECTS, INNER = ["dobj", "obj", "attr"], ["nsubj", "nsubj:pass"], ["pobj", "obj"]
CLAUSE_CHARS = 140
CONFIDENCE = {"strong": 0.75, "weak": 0.60, "construction": 0.05, "marker": 0.60, "attribution": 0.75}


def candidates(tokens: DataFrame, entities: DataFrame, chunks: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, text, label, head_i): entities, noun chunks of three characters or more that are no pronoun, lone nominalisations outside both, and anchors; of one span's labels the first by priority stays."""
    head = tokens.select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("_i"), "head_i")
    e = entities.where(F.col("label").isin("PERSON", "ORG", "GPE")).select("doc_id", "start", "end", "text", "label", (F.col("end") - 1).alias("head_i"))
    c = chunks.where("root_pos <> 'PRON' AND length(trim(text)) >= 3").select("doc_id", "start", "end", "text", F.lit("NP").alias("label"), F.col("root_i").alias("head_i"))
    named = e.unionByName(c)
    spans = named.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    alone = tokens.where(nominalisation(F.col("lemma"))).join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("tok_i") >= F.col("_s")) & (F.col("tok_i") < F.col("_e")), "left_anti")
    out = named.unionByName(alone.select("doc_id", F.col("tok_i").alias("start"), (F.col("tok_i") + 1).alias("end"), "text", F.lit("NOMINALIZATION").alias("label"), F.col("tok_i").alias("head_i")))
    if anchors is not None:
        out = out.unionByName(anchors.withColumn("label", F.lit("ANCHOR")).select(out.columns))
    rank = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("label"))
    return keep_first(out, ["doc_id", "start", "end"], [rank, F.col("head_i")])


def anchors(tokens: DataFrame, variants: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, head_i): for each document the first place of its person's longest variant (doc_id, variant); -1 for start where the text has none."""
    words = variants.select("doc_id", "variant", F.split(F.lower("variant"), " ").alias("w"), F.length("variant").alias("n"))
    text = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_i", "lower"))).alias("t"))
    m = words.join(text, "doc_id").withColumn("at", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice(F.transform("t", lambda x: x["lower"]), i, F.size("w")) == F.col("w")))
    found = keep_first(m.where(F.size("at") > 0), ["doc_id"], [F.col("n").desc(), F.col("variant")])
    found = found.select("doc_id", (F.element_at("at", 1) - 1).alias("start"), (F.element_at("at", 1) - 1 + F.size("w")).alias("end"), F.col("variant").alias("text"))
    lone = keep_first(variants.join(found, "doc_id", "left_anti"), ["doc_id"], [F.length("variant").desc(), F.col("variant")])
    lone = lone.select("doc_id", F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col("variant").alias("text"))
    return found.unionByName(lone).withColumn("head_i", F.when(F.col("start") < 0, -1).otherwise(F.col("end") - 1))


def eventlike(s: str) -> Column:
    """Whether the span in columns s_* is an outcome."""
    lemma, text = F.lower(f"{s}_lemma"), F.lower(f"{s}_text")
    words = F.rlike(text, F.lit("|".join(EFFECT_WORDS)))
    return (F.col(f"{s}_start") >= 0) & ~lemma.isin(NO_EFFECT) & (F.col(f"{s}_pos") != "PRON") & (lemma.isin(EFFECTS) | nominalisation(lemma) | (F.col(f"{s}_label") == "NOMINALIZATION") | words)


def plausible(s: str) -> Column:
    """Whether the span in columns s_* can be a cause; a person that the text doesn't name always can."""
    nominal = F.col(f"{s}_pos").isin("NOUN", "PROPN") | (nominalisation(F.lower(f"{s}_lemma")) & (F.col(f"{s}_pos") != "PRON"))
    return (F.col(f"{s}_start") < 0) | (nominal & (F.coalesce(f"{s}_first", F.lit("")) != "whose"))


class _Document:
    """Views over one set of annotations: children of verbs, and the span of a token."""

    def __init__(self, tokens: DataFrame, spans: DataFrame) -> None:
        self.tokens, self.spans = tokens, spans
        info = tokens.select("doc_id", F.col("tok_i").alias("head_i"), F.col("lemma").alias("lemma"), F.col("pos").alias("pos"))
        first = tokens.select("doc_id", F.col("tok_i").alias("start"), F.col("lower").alias("first"))
        # spans are described once, then dealt to tokens; both are read by every family, which would compute them anew each time
        self.described = spans.join(info, ["doc_id", "head_i"], "left").join(first, ["doc_id", "start"], "left").persist()
        self.of_token = smallest_span(tokens.select("doc_id", "tok_i"), self.described).persist()

    def child(self, parents: DataFrame, of: str, name: str, deps: list[str], lemmas: list[str] | None = None) -> DataFrame:
        """parents with columns name and name_lemma: the first child of token ``of`` with such a dependency."""
        c = self.tokens.where(F.col("dep").isin(deps) & (F.col("tok_i") != F.col("head_i")))
        if lemmas:
            c = c.where(F.lower("lemma").isin(lemmas))
        one = c.groupBy(F.col("doc_id").alias("_d"), F.col("head_i").alias("_h")).agg(F.min("tok_i").alias(name), F.lower(F.min_by("lemma", "tok_i")).alias(f"{name}_lemma"))
        return parents.join(one, (F.col("doc_id") == F.col("_d")) & (F.col(of) == F.col("_h")), "left").drop("_d", "_h")

    def span(self, df: DataFrame, token: str, name: str) -> DataFrame:
        """df with the columns of the smallest span that holds the token, named name_*."""
        s = self.of_token.select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("_t"), *[F.col(c).alias(f"{name}_{c}") for c in ("start", "end", "text", "label", "head_i", "lemma", "pos", "first")])
        return df.join(s, (F.col("doc_id") == F.col("_d")) & (F.col(token) == F.col("_t")), "left").drop("_d", "_t")


def _edge(df: DataFrame, relation: Column | str, cause: str, effect: str, confidence: Column, evidence: Column, at: str) -> DataFrame:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    return df.select("doc_id", relation.alias("relation"), squeeze(F.col(cause)).alias("cause"), squeeze(F.col(effect)).alias("effect"), F.round(confidence, 6).alias("confidence"), evidence.alias("evidence"), F.col(at).alias("at"))


def verb_edges(d: _Document) -> DataFrame:
    """Causative verbs: strong ones, weak ones with their preposition; active, and passive with a by-phrase."""
    v = d.tokens.where("pos = 'VERB'").select("doc_id", "tok_i", F.lower("lemma").alias("verb")).where(F.col("verb").isin(STRONG + list(WEAK)))
    v = d.child(v, "tok_i", "subject", SUBJECTS)
    v = d.child(v, "tok_i", "object", OBJECTS)
    v = d.child(v, "tok_i", "prep", ["prep"])
    v = d.child(v, "prep", "inner", INNER)
    v = d.child(v, "tok_i", "by", ["prep"], ["by"])
    v = d.child(v, "by", "agent", INNER)
    strong = F.col("verb").isin(STRONG)
    fits = strong
    for verb, preps in WEAK.items():
        needs = F.col("prep_lemma").isin(preps) & F.col("inner").isNotNull() if preps else F.col("object").isNotNull() | F.col("inner").isNotNull()
        fits = fits | ((F.col("verb") == verb) & needs)
    v = v.where(F.coalesce(fits, F.lit(False))).withColumn("effect_token", F.coalesce("object", "inner"))
    base = F.when(strong, CONFIDENCE["strong"]).otherwise(CONFIDENCE["weak"])
    more = F.when(~strong & F.col("prep").isNotNull() & F.col("inner").isNotNull(), CONFIDENCE["construction"]).otherwise(0.0)
    out = []
    for cause, effect, confidence, name in (("subject", "effect_token", base + more, "causative_verb"), ("agent", "subject", base, "passive_causative_verb")):
        e = d.span(d.span(v, cause, "c"), effect, "e").where((F.col("c_text") != F.col("e_text")) & plausible("c") & eventlike("e"))
        out.append(_edge(e, "CAUSED", "c_text", "e_text", confidence, F.concat(F.lit(f"{name}:"), F.col("verb")), "tok_i"))
    return out[0].unionByName(out[1])


def marker_edges(d: _Document) -> DataFrame:
    """because of, due to, as a result of: the first nominal after it is the cause; the object of the nearest verb before it, if an outcome, else the nearest nominal before it, the effect."""
    w = Window.partitionBy("doc_id").orderBy("tok_i")
    t = d.tokens
    for i in range(1, 4):
        t = t.withColumn(f"_n{i}", F.lead("lower", i).over(w))
    found = []
    for m in MARKERS:
        first, *rest = m.split()
        hit = reduce(lambda a, b: a & b, [F.col(f"_n{i + 1}") == x for i, x in enumerate(rest)], F.col("lower") == first)
        found.append(t.where(hit).select("doc_id", F.col("tok_i").alias("m_start"), (F.col("tok_i") + len(rest)).alias("m_end"), F.lit(m.replace(" ", "_")).alias("marker")))
    marks = reduce(DataFrame.unionByName, found)
    spans = d.described.where(F.col("label").isin("NP", "NOMINALIZATION", "ORG", "PERSON", "GPE") & (F.col("start") >= 0))
    side = lambda n: spans.select(F.col("doc_id").alias("_d"), *[F.col(c).alias(f"{n}_{c}") for c in ("start", "end", "text", "label", "head_i", "lemma", "pos", "first")])
    same = F.col("doc_id") == F.col("_d")
    key = ["doc_id", "m_start", "marker"]
    cause = keep_first(marks.join(side("c"), same & (F.col("c_start") > F.col("m_end"))).drop("_d"), key, [F.col("c_start"), F.col("c_end"), F.col("c_label")])
    verbs = d.tokens.where("pos = 'VERB' AND dep NOT IN ('aux', 'auxpass')").select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("verb_i"))
    last = marks.join(verbs, same & (F.col("verb_i") < F.col("m_start"))).groupBy(*key).agg(F.max("verb_i").alias("verb_i"))
    by_verb = d.span(d.child(last, "verb_i", "object", OBJECTS), "object", "e").where(eventlike("e")).select(*key, *[f"e_{c}" for c in ("start", "end", "text", "label", "head_i", "lemma", "pos", "first")], F.lit(0).alias("_how"))
    near = keep_first(marks.join(side("e"), same & (F.col("e_end") <= F.col("m_start"))).drop("_d"), key, [F.col("e_end").desc(), F.col("e_start"), F.col("e_label")])
    near = near.select(*key, *[f"e_{c}" for c in ("start", "end", "text", "label", "head_i", "lemma", "pos", "first")], F.lit(1).alias("_how"))
    effect = keep_first(by_verb.unionByName(near), key, [F.col("_how")])
    e = cause.join(effect, key).where((F.col("e_label") != "PERSON") & plausible("c") & eventlike("e"))
    return _edge(e, "CAUSAL_PREP", "c_text", "e_text", F.lit(CONFIDENCE["marker"]), F.concat(F.lit("marker:"), F.col("marker")), "e_head_i")


def attribution_edges(d: _Document) -> DataFrame:
    """blame Y for Z and the like. hold counts only with responsible, accountable or culpable below it; accuse takes a clause of up to 140 characters too."""
    v = d.tokens.where("pos = 'VERB'").select("doc_id", "tok_i", F.lower("lemma").alias("verb")).where(F.col("verb").isin(list(ATTRIBUTION)))
    held = d.tokens.where(F.lower("lemma").isin(HELD)).select("doc_id", "head_i")
    heads = d.tokens.join(held.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tok_i", "head_i"))).alias("heads"))

    def up(chain: Column) -> Column:  # a step to the head; the root is its own
        above = F.element_at(F.col("heads"), F.element_at(chain, -1))
        return F.when(above.isNull() | F.array_contains(chain, above), chain).otherwise(F.concat(chain, F.array(above)))

    reach = held.join(heads, "doc_id").select(F.col("doc_id").alias("_d"), F.explode(F.aggregate(F.map_keys("heads"), F.array("head_i"), lambda chain, _: up(chain))).alias("_a")).distinct()
    ok = v.join(reach, (F.col("doc_id") == F.col("_d")) & (F.col("tok_i") == F.col("_a")), "left_semi")
    v = v.where("verb <> 'hold'").unionByName(ok.where("verb = 'hold'"))
    v = d.child(v, "tok_i", "object", ["dobj", "obj"])
    v = d.child(v, "tok_i", "prep", ["prep"], ["for", "of", "with"])
    v = d.child(v, "prep", "inner", INNER).where("object IS NOT NULL AND inner IS NOT NULL")
    v = d.span(d.span(v, "object", "c"), "inner", "e").where("c_text IS NOT NULL")
    clause = d.child(v.where("e_text IS NULL AND verb = 'accuse'"), "inner", "clause", ["xcomp", "ccomp"]).withColumn("clause", F.coalesce("clause", "inner"))
    words = d.tokens.select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("_t"), F.col("head_i").alias("_h"), "text")
    kids = clause.join(words, (F.col("doc_id") == F.col("_d")) & ((F.col("_h") == F.col("clause")) | (F.col("_t") == F.col("clause")))).groupBy("doc_id", "tok_i").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("_t", "text"))), lambda x: x["text"]), " ").alias("clause_text"))
    clause = clause.join(kids, ["doc_id", "tok_i"]).where(F.length("clause_text").between(1, CLAUSE_CHARS)).withColumn("e_text", F.col("clause_text"))
    relation = F.create_map(*[F.lit(x) for kv in ATTRIBUTION.items() for x in kv])[F.col("verb")]
    accuse = F.col("verb") == "accuse"
    e = v.where("e_text IS NOT NULL").where(F.when(accuse, ~F.lower("e_lemma").isin(NO_EFFECT)).otherwise(eventlike("e")))
    e = e.select("doc_id", "tok_i", "verb", "c_text", "e_text").unionByName(clause.select("doc_id", "tok_i", "verb", "c_text", "e_text"))
    e = e.where(F.lower(squeeze(F.col("c_text"))) != F.lower(squeeze(F.col("e_text"))))
    return _edge(e, relation, "c_text", "e_text", F.lit(CONFIDENCE["attribution"]), F.concat(F.lit("attrib_verb:"), F.col("verb")), "tok_i")


def edges(tokens: DataFrame, spans: DataFrame, snippets: DataFrame) -> DataFrame:
    """causal_edges of all three families. snippets (doc_id, person, article_index, snippet_index) tell whose they are; of edges that differ in case alone the most certain stays."""
    d = _Document(tokens, spans)
    found = reduce(DataFrame.unionByName, [verb_edges(d), marker_edges(d), attribution_edges(d)])
    where = tokens.select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("_t"), "sent_id")
    found = found.join(where, (F.col("doc_id") == F.col("_d")) & (F.col("at") == F.col("_t")), "left").drop("_d", "_t")
    named = found.join(snippets, "doc_id").withColumn("_seq", F.struct("at", "evidence"))
    return best_edges(named, "_seq").select("person", "article_index", "snippet_index", "relation", "cause", "effect", "confidence", "evidence", F.coalesce("sent_id", F.lit(0)).alias("sent_id"))


def classified(classify: Callable[[list[str]], list[float]], text: Column, cause: Column, effect: Column) -> Column:
    """The probability a classifier gives to pairs of cause and effect, marked in their text. It is called with a batch of texts at a time, in the workers; it has to be picklable, and loads what it needs when first called."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(classify(texts.tolist()), dtype=float)

    return run(pair_text(text, cause, effect))


def rescore(found: DataFrame, probability: Column, threshold: float = 0.55) -> DataFrame:
    """Edges whose confidence times the classifier's probability reaches the threshold."""
    combined = F.col("confidence") * probability
    return found.withColumn("confidence", combined).where(F.col("confidence") >= threshold).withColumn("evidence", F.concat("evidence", F.lit("|clf")))


def aggregate(found: DataFrame) -> DataFrame:
    return found.groupBy("article_index", "person").agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.avg("confidence"), 6).alias("mean_conf"), F.max("confidence").alias("max_conf"))
