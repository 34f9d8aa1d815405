"""Scoring personas by the verbs they do and suffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.functions.text import persona_name, pronoun
from presslens.operators.filters import NO_PERSONA
from presslens.operators.joins import few, without_overlap
from presslens.operators.sampling import resamples
from presslens.schema import require

#: The scores of agent and theme for each label of the power and agency lexicon.
LABELS = {"power_agent": (1, -1), "power_theme": (-1, 1), "power_equal": (0, 0), "agency_pos": (1, 0), "agency_neg": (-1, 0), "agency_equal": (0, 0)}


def lexicon(table: DataFrame, verb: str, agent: str, theme: str, seq: str | None = None) -> DataFrame:
    """(verb, agent, theme) of a table of scores; of a verb that repeats the last row counts."""
    require(table, verb, agent, theme)
    order = F.col(seq) if seq else F.struct(F.col(agent), F.col(theme))
    t = table.where(F.length(F.trim(verb)) > 0).groupBy(F.trim(verb).alias("verb"))
    return t.agg(F.max_by(F.struct(F.col(agent).cast("double").alias("a"), F.col(theme).cast("double").alias("t")), order).alias("s")).select("verb", F.coalesce("s.a", F.lit(0.0)).alias("agent"), F.coalesce("s.t", F.lit(0.0)).alias("theme"))


def frame_lexicon(table: DataFrame, dimension: str, seq: str | None = None) -> DataFrame:
    return lexicon(table.select("verb", F.col(f"`{dimension}(a)`").alias("_a"), F.col(f"`{dimension}(t)`").alias("_t"), *([seq] if seq else [])), "verb", "_a", "_t", seq)


def label_lexicon(table: DataFrame, dimension: str, seq: str | None = None) -> DataFrame:
    """Scores of the labels in a column (power or agency); rows without a label say nothing."""
    flat = lambda i: F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, float(v[i]))])
    t = table.where(F.col(dimension).isNotNull())
    return lexicon(t.select("verb", flat(0)[F.col(dimension)].alias("_a"), flat(1)[F.col(dimension)].alias("_t"), *([seq] if seq else [])), "verb", "_a", "_t", seq)


def pattern_events(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, persona, role, verb, surface) of subject and object chunks that match a persona's pattern."""
    c = chunks.where(F.col("root_dep").isin("nsubj", "dobj"))
    return c.join(few(patterns, 10_000), F.rlike(F.lower("text"), F.col("pattern"))).select("doc_id", "persona", F.col("root_dep").alias("role"), F.lower("head_lemma").alias("verb"), F.lower("text").alias("surface"))


class PeopleWords:
    """Words that stand for people in pattern mode: set() replaces them, add() adds to them. Each is a persona of its own."""

    def __init__(self, words: list[str] | None = None) -> None:
        self.words: list[str] = []
        self.add(words or [])

    def set(self, words: list[str]) -> PeopleWords:
        self.words = []
        return self.add(words)

    def add(self, words: list[str]) -> PeopleWords:
        self.words += [w for w in dict.fromkeys(x.strip().lower() for x in words) if w and w not in self.words]
        return self

    def relation(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w,) for w in self.words], "word string")


def people_word_events(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, persona, role, verb, surface) of subject and object chunks that hold a word for people (words: word): an equi-join on the chunks' words."""
    c = chunks.where(F.col("root_dep").isin("nsubj", "dobj")).withColumn("surface", F.lower("text"))
    w = words.select(F.lower("word").alias("persona")).distinct()
    held = c.withColumn("persona", F.explode(F.array_distinct(F.split(F.trim("surface"), r"\s+"))))
    return held.join(w, "persona").select("doc_id", "persona", F.col("root_dep").alias("role"), F.lower("head_lemma").alias("verb"), "surface")


def cluster_names(coref: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, persona): the pronoun that every mention is a form of, else the first mention without determiner and punctuation."""
    named = coref.withColumn("_p", pronoun(F.trim("text")))
    per = named.groupBy("doc_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count("_p").alias("k"), F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.min_by("text", F.struct("mention_id", "start")).alias("first"))
    return per.select("doc_id", "cluster_id", F.when((F.col("k") == F.col("n")) & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(persona_name(F.col("first"))).alias("persona"))


def discovered_events(coref: DataFrame, chunks: DataFrame, subject_dep: str = "nsubj") -> DataFrame:
    """(doc_id, persona, role, verb, surface) of the mentions in clusters and of chunks that meet no cluster. role and verb are null for mentions that are neither subject nor object.

    subject_dep="ROOT" takes the mention's root itself for the verb, as older pipelines did.
    """
    m = coref.join(cluster_names(coref), ["doc_id", "cluster_id"])
    subject = F.col("root_dep") == subject_dep
    verb = F.when(subject, F.col("root_lemma") if subject_dep == "ROOT" else F.col("head_lemma")).when(F.col("root_dep") == "dobj", F.col("head_lemma"))
    role = F.when(subject, "nsubj").when(F.col("root_dep") == "dobj", "dobj")
    inside = m.select("doc_id", "persona", role.alias("role"), F.lower(verb).alias("verb"), F.lower("text").alias("surface"))
    alone = without_overlap(chunks, coref)
    role = F.when(F.col("root_dep").isin("nsubj", "dobj"), F.col("root_dep"))
    outside = alone.select("doc_id", persona_name(F.col("text")).alias("persona"), role.alias("role"), F.when(role.isNotNull(), F.lower("head_lemma")).alias("verb"), F.lower("text").alias("surface"))
    return inside.unionByName(outside).where(~F.col("persona").isin(NO_PERSONA))


def verb_args(events: DataFrame) -> DataFrame:
    """(doc_id, persona, role, verb, cnt)."""
    return events.where("role IS NOT NULL").groupBy("doc_id", "persona", "role", "verb").agg(F.count(F.lit(1)).alias("cnt"))


class PersonaScorer:
    """Scores of personas over (doc_id, persona, role, verb, cnt), a lexicon (verb, agent, theme) and mention counts. Every result is a lazy relation."""

    def __init__(self, args: DataFrame, lexicon: DataFrame, mentions: DataFrame | None = None, documents: DataFrame | None = None) -> None:
        self.args, self.lexicon, self.documents = args, lexicon, documents
        #: (persona, surface, n)
        self.mentions = mentions if mentions is not None else args.groupBy("persona").agg(F.sum("cnt").alias("n")).withColumn("surface", F.col("persona"))
        score = F.when(F.col("role") == "nsubj", F.col("agent")).otherwise(F.col("theme"))
        self.scored = args.join(lexicon, "verb").withColumn("score", score)

    @classmethod
    def of_events(cls, events: DataFrame, lexicon: DataFrame, documents: DataFrame | None = None) -> "PersonaScorer":
        return cls(verb_args(events), lexicon, events.groupBy("persona", "surface").agg(F.count(F.lit(1)).alias("n")), documents)

    def persona_counts(self) -> DataFrame:
        return self.mentions.groupBy("persona").agg(F.sum("n").cast("long").alias("mention_count"))

    def persona_cluster(self, persona: str | None = None) -> DataFrame:
        """(persona, surface, n): the forms a persona was mentioned by."""
        m = self.mentions.groupBy("persona", "surface").agg(F.sum("n").cast("long").alias("n"))
        return m if persona is None else m.where(F.col("persona") == persona)

    def match_counts(self) -> DataFrame:
        return self.scored.groupBy("persona").agg(F.count(F.lit(1)).alias("match_count"))

    def totals(self, frequency_threshold: int = 0) -> DataFrame:
        """(persona, score, match_count): summed scores over the persona's mentions, for personas with matches enough."""
        s = self.scored.groupBy("persona").agg(F.sum(F.col("cnt") * F.col("score")).alias("sum"), F.count(F.lit(1)).alias("match_count"))
        return s.join(self.persona_counts(), "persona").where(F.col("match_count") >= frequency_threshold).select("persona", (F.col("sum") / F.col("mention_count")).alias("score"), "match_count")

    def by_document(self, frequency_threshold: int = 0) -> DataFrame:
        """(doc_id, persona, score, scored_verbs): a document's score over its own verb arguments; the threshold is on the persona's matches in the corpus."""
        s = self.scored.groupBy("doc_id", "persona").agg(F.sum(F.col("cnt") * F.col("score")).alias("sum"), F.count(F.lit(1)).alias("scored_verbs"))
        n = self.args.groupBy("doc_id", "persona").agg(F.sum("cnt").alias("n"))
        kept = self.match_counts().where(F.col("match_count") >= frequency_threshold)
        return s.join(n, ["doc_id", "persona"]).join(kept, "persona", "left_semi").select("doc_id", "persona", (F.col("sum") / F.col("n")).alias("score"), "scored_verbs")

    def polarity(self) -> DataFrame:
        """(persona, sign, verb_role, n): documents in which a persona has a verb of that sign; verbs of score 0 are left out."""
        s = self.scored.where("score <> 0").withColumn("sign", F.when(F.col("score") > 0, "positive").otherwise("negative"))
        return s.groupBy("persona", "sign", F.concat_ws("_", "verb", "role").alias("verb_role")).agg(F.count(F.lit(1)).alias("n"))

    def polarity_map(self) -> DataFrame:
        """(persona, sign, verbs): the same as a map, for reading."""
        return self.polarity().groupBy("persona", "sign").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("verb_role", "n")))).alias("verbs"))

    def top_verbs(self, k: int = 10) -> DataFrame:
        """The k most frequent verbs of each persona and sign; of equals the later by name."""
        w = Window.partitionBy("persona", "sign").orderBy(F.col("n").desc(), F.col("verb_role").desc())
        return self.polarity().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def top_personas(self, k: int, frequency_threshold: int = 0) -> DataFrame:
        """The k highest scores, or for negative k the -k lowest."""
        order = F.col("score").desc() if k > 0 else F.col("score")
        return self.totals(frequency_threshold).orderBy(order, "persona").limit(abs(k))

    def verb_coverage(self) -> DataFrame:
        return self.scored.groupBy("verb").agg(F.count(F.lit(1)).alias("n"))

    def verbs_of_document(self, role: str | None = None) -> DataFrame:
        """(doc_id, persona, role, verbs): a document's verb arguments by persona and role."""
        a = self.args if role is None else self.args.where(F.col("role") == role)
        return a.groupBy("doc_id", "persona", "role").agg(F.sum("cnt").alias("verbs"))

    def documents_with_verb(self, verb: str) -> DataFrame:
        return self.args.where(F.lower("verb") == verb.lower()).select("doc_id").distinct()

    def documents_with_persona(self, persona: str) -> DataFrame:
        """Documents in which a scored verb has the persona in either role."""
        both = [self.scored.where((F.col("role") == r) & (F.lower("persona") == persona.lower())).select("doc_id") for r in ("nsubj", "dobj")]
        return reduce(DataFrame.union, both).distinct()

    def matched_pairs(self) -> DataFrame:
        return self.args.join(self.lexicon, "verb", "left_semi")

    def bootstrap(self, replicates: int, seed: int = 0) -> DataFrame:
        """(persona, score, sd, replicates): mean and population deviation of scores over resampled documents, each over the persona's verb arguments in that resample; a resample without the persona doesn't count."""
        times = resamples(self.args, replicates, "doc_id", seed)
        top = self.scored.groupBy("doc_id", "persona").agg(F.sum(F.col("cnt") * F.col("score")).alias("s"))
        n = self.args.groupBy("doc_id", "persona").agg(F.sum("cnt").alias("n"))
        one = n.join(top, ["doc_id", "persona"], "left")
        r = times.join(one, "doc_id").groupBy("b", "persona").agg(F.sum(F.col("t") * F.col("s")).alias("s"), F.sum(F.col("t") * F.col("n")).alias("n")).where("s IS NOT NULL")
        return r.groupBy("persona").agg(F.avg(F.col("s") / F.col("n")).alias("score"), F.stddev_pop(F.col("s") / F.col("n")).alias("sd"), F.count(F.lit(1)).alias("replicates"))


def group_scores(scores: DataFrame, people: DataFrame, group: str) -> DataFrame:
    """(group, score, n): the sum of scores over the number of people of each group."""
    return scores.join(people, "persona").groupBy(group).agg((F.sum("score") / F.count("persona")).alias("score"), F.count("persona").alias("n"))
