"""Annotation relations: a rule-based producer, so that everything after it is joins and counts.

A better annotator can fill the same relations; nothing here claims its quality.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.schema import RELATIONS

#: Closed classes of words.
BE = {"am", "is", "are", "was", "were", "be", "been", "being"}
DETERMINERS = {"the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their"}
PREPOSITIONS = {"of", "in", "on", "at", "by", "for", "with", "to", "into", "about", "from", "over", "under", "after", "before", "as"}
PERSONAL = {"i", "me", "we", "us", "you", "he", "him", "she", "her", "it", "they", "them", "who", "whom"}
VERB_FORMS = {"has": "have", "had": "have", "did": "do", "does": "do", "said": "say", "says": "say", "went": "go", "goes": "go", "took": "take", "gave": "give", "made": "make", "led": "lead", "leads": "lead", "brought": "bring", "held": "hold"}
#: A worker gives back so many tokens at once.
HELD_TOKENS = 20_000
TOKEN = re.compile(r"[\w'’-]+|[^\w\s]", re.UNICODE)
BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"‘’“”])")


def lemma(word: str) -> str:
    w = word.lower()
    if w in BE:
        return "be"
    if w in VERB_FORMS:
        return VERB_FORMS[w]
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith("ss"):
            base = w[: -len(end)] + put
            return base[:-1] if len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" and end in ("ing", "ed") else base
    return w


def part_of_speech(word: str, before: str | None) -> str:
    w = word.lower()
    if not re.search(r"\w", w):
        return "PUNCT"
    if w in PERSONAL:
        return "PRON"
    if w in DETERMINERS:
        return "DET"
    if w in PREPOSITIONS:
        return "ADP"
    if w in BE:
        return "AUX"
    if word[0].isupper() and before is not None:
        return "PROPN"
    if w in VERB_FORMS or w.endswith(("ed", "ing")) and before not in DETERMINERS:
        return "VERB"
    return "NOUN"


def tokens_of(text: str) -> list[dict]:
    """Tokens with sentence, lemma, part of speech, and for each verb a subject before and an object after it."""
    out, at = [], 0
    for s, sentence in enumerate(x for x in BOUNDARY.split(text) if x.strip()):
        start = text.index(sentence, at)
        before, first = None, len(out)
        for m in TOKEN.finditer(sentence):
            out.append({"tok_i": len(out), "sent_id": s, "text": m[0], "lower": m[0].lower(), "lemma": lemma(m[0]), "pos": part_of_speech(m[0], before), "dep": "dep", "head_i": len(out), "char_start": start + m.start(), "char_end": start + m.end()})
            before = m[0].lower()
        at = start + len(sentence)
        row = out[first:]
        for i, t in enumerate(row):
            if t["pos"] != "VERB":
                continue
            t["dep"] = "ROOT"
            left = next((x for x in reversed(row[:i]) if x["pos"] in ("NOUN", "PROPN", "PRON") and x["dep"] == "dep"), None)
            right = next((x for x in row[i + 1 :] if x["pos"] in ("NOUN", "PROPN", "PRON", "ADP", "VERB")), None)
            if left:
                left.update(dep="nsubj", head_i=t["tok_i"])
            if right and right["pos"] in ("NOUN", "PROPN", "PRON"):
                right.update(dep="dobj", head_i=t["tok_i"])
            elif right and right["pos"] == "ADP":
                right.update(dep="prep", head_i=t["tok_i"])
                noun = next((x for x in row[row.index(right) + 1 :] if x["pos"] in ("NOUN", "PROPN", "PRON")), None)
                if noun:
                    noun.update(dep="pobj", head_i=right["tok_i"])
    return out


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", annotator: Callable[[str], list[dict]] = tokens_of) -> DataFrame:
    """ann_token for every document; the tokens of many short texts, or of one long one, are given back together."""
    names = [f.split()[0] for f in RELATIONS["ann_token"].split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}
    types = [kinds[f.split()[1]] for f in RELATIONS["ann_token"].split(", ")]

    def packed(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                t, d = t.as_py(), d.as_py()
                held += [{**r, "doc_id": d} for r in annotator(t)] if t is not None else []
                if len(held) >= HELD_TOKENS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RELATIONS["ann_token"])


def people(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """ann_entity of PERSON for runs of two capitalised words or more; positions are the run's number in the text."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)+)"), 1)
    e = docs.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(runs).alias("start", "text"))
    return e.select("doc_id", "start", (F.col("start") + 1).alias("end"), "text", F.lit("PERSON").alias("label"))


def chunks(tokens: DataFrame) -> DataFrame:
    """ann_chunk of nominal tokens, with a determiner before them taken in."""
    t = tokens.alias("t")
    head = tokens.select(F.col("doc_id").alias("_d"), F.col("tok_i").alias("_h"), F.col("lemma").alias("head_lemma"))
    det = tokens.where("pos = 'DET'").select(F.col("doc_id").alias("_dd"), (F.col("tok_i") + 1).alias("_n"), F.col("text").alias("_det"))
    c = t.where("pos IN ('NOUN', 'PROPN', 'PRON')").join(head, (F.col("doc_id") == F.col("_d")) & (F.col("head_i") == F.col("_h"))).join(det, (F.col("doc_id") == F.col("_dd")) & (F.col("tok_i") == F.col("_n")), "left")
    start = F.col("tok_i") - F.col("_det").isNotNull().cast("int")
    return c.select("doc_id", start.alias("start"), (F.col("tok_i") + 1).alias("end"), F.concat_ws(" ", "_det", "text").alias("text"), F.col("tok_i").alias("root_i"), F.col("dep").alias("root_dep"), F.col("pos").alias("root_pos"), "head_lemma")


def annotate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> dict[str, DataFrame]:
    t = tokens(docs, text, key).persist()  # every relation and family reads it; a lost part is annotated again
    return {"ann_token": t, "ann_chunk": chunks(t), "ann_entity": people(docs, text, key)}
