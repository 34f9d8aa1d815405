"""Tagging the people that articles mention, and the sentences that do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.functions.text import sentences, tag_of, tags

#: Capitalised words in a row: who the rule-based annotator takes for people.
CAPITALS = re.compile(r"\b[A-Z][\w'’-]+(?:\s+[A-Z][\w'’-]+)*")
WORD = re.compile(r"\w+")
#: So many names at most are compiled into the workers' patterns; a gazetteer is far smaller.
MOST_NAMES = 200_000
#: A worker tags so many texts, or characters, before it gives them back; it remembers the nearest name of so many.
SLICE_ROWS, SLICE_CHARS, REMEMBERED = 1_000, 1_000_000, 65_536


class Tagger:
    """Tags one text: whole names first, the longest first; then single words that a person found in the text goes by, if they occur in what the annotator takes for a person."""

    def __init__(self, names: dict[str, str], gated: dict[str, set[str]], people: Callable[[str], list[str]] | None = None, gate: str = "person", fuzzy: float | None = None) -> None:
        self.names = names
        several = sorted((n for n in names if " " in n or gate == "none"), key=lambda n: (-len(n), n))
        self.by_word: dict[str, list[tuple[int, re.Pattern, str]]] = {}
        for i, n in enumerate(several):
            self.by_word.setdefault(next(iter(WORD.findall(n.lower())), ""), []).append((i, re.compile(rf"\b{re.escape(n)}\b", re.IGNORECASE), names[n]))
        self.gated, self.people, self.gate, self.fuzzy = gated, people or CAPITALS.findall, gate, fuzzy
        self.nearest: dict[str, str | None] = {}
        self.by_length: dict[int, list[tuple[str, str]]] = {}
        for n in sorted(n for n in names if " " in n) if fuzzy is not None else ():
            words = _sorted_words(n)
            self.by_length.setdefault(len(words), []).append((words, n))

    def __call__(self, text: str | None) -> str:
        if text is None or not text.strip():
            return ""
        out, found, low = text, set(), text.lower()
        # only names whose first word the text has, in the order of all: the work follows the text, not the gazetteer
        fits = sorted((x for w in {"", *WORD.findall(low)} for x in self.by_word.get(w, [])), key=lambda x: x[0])
        for _, pattern, tag in fits:
            if pattern.search(out):
                found.add(tag)
                out = pattern.sub(tag, out)
        if self.gate == "none":
            return out
        people = self.people(text)
        words = {w for p in people for w in (p, *p.split())} if found else set()
        for word in sorted(words, key=lambda w: (-len(w), w)):
            fits = self.gated.get(word.lower(), set()) & found
            if len(fits) == 1:
                out = re.sub(rf"\b{re.escape(word)}\b", next(iter(fits)), out)
        if self.fuzzy is not None:
            for p in sorted(set(people), key=lambda w: (-len(w), w)):
                tag = self._nearest(p)
                if tag:
                    out = re.sub(rf"\b{re.escape(p)}\b", tag, out, flags=re.IGNORECASE)
        return out

    def _nearest(self, name: str) -> str | None:
        """The tag of the most alike name of several words that reaches the threshold; of equals the first by name. Names recur, so answers are kept."""
        name = name.lower()
        if name not in self.nearest:
            if len(self.nearest) >= REMEMBERED:
                self.nearest.clear()
            self.nearest[name] = self._compared(name)
        return self.nearest[name]

    def _compared(self, name: str) -> str | None:
        if name in self.names:  # whole names are tagged by now, and a lone word only where its person was found
            return None
        words = _sorted_words(name)
        places, best = _places(words), (-1.0, "")
        for m, known in self.by_length.items():
            # no more than the shorter one can be common
            if 200.0 * min(len(words), m) < self.fuzzy * (len(words) + m):
                continue
            for other, n in known:
                score = _ratio(places, len(words), other)
                if score > best[0] or score == best[0] and n < best[1]:
                    best = (score, n)
        return self.names[best[1]] if best[0] >= self.fuzzy else None


def _sorted_words(name: str) -> str:
    return " ".join(sorted(name.split()))


def _places(a: str) -> dict[str, int]:
    """For each character the bits of its places in a."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _ratio(places: dict[str, int], n: int, b: str) -> float:
    """Twice the longest common subsequence of a (its places, its length) and b over both lengths, times 100; a row of the usual table at once, as bits."""
    if not n and not b:
        return 100.0
    every = (1 << n) - 1
    row = every
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return 200.0 * (n - row.bit_count()) / (n + len(b))


def sort_ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence of the sorted words over both lengths."""
    a = _sorted_words(a)
    return _ratio(_places(a), len(a), _sorted_words(b))


def resolve_pronouns(text: str, clusters: list[list[tuple[int, int]]]) -> str:
    """A text whose pronouns are replaced by their cluster's first other mention. Clusters are lists of character spans."""
    swaps = []
    for spans in clusters:
        names = [text[a:b] for a, b in spans if text[a:b].lower() not in PRONOUN_FORMS]
        swaps += [(a, b, names[0]) for a, b in spans if names and text[a:b].lower() in PRONOUN_FORMS]
    for a, b, name in sorted(swaps, reverse=True):
        text = text[:a] + name + text[b:]
    return text


#: Pronouns that stand for a person named before.
PRONOUN_FORMS = {"he", "him", "his", "himself", "she", "her", "hers", "herself", "they", "them", "their", "theirs", "themselves"}


def tag(df: DataFrame, names: DataFrame, gated: DataFrame, text: str = "content", mode: str = "coref", coref: str | None = None, people: Callable[[str], list[str]] | None = None) -> DataFrame:
    """df with tagged_text and tag_error. mode: coref (pronouns replaced by the spans in column ``coref``, if given, then names, then gated words), ner (no pronouns, near names too) or all (every name, ungated).

    Replacing is sequential within a text, so that each text is one call, and only a slice of texts is held beside the batch that Spark sends; the gazetteer, checked for size, goes to the workers once. A text that fails stays as it is and its error is told. Null and blank texts become "".
    """
    n = {r.alias: r.tag for r in names.limit(MOST_NAMES + 1).collect()}
    if len(n) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: tag with joins on tokens instead")
    g: dict[str, set[str]] = {}
    for r in gated.collect():
        g.setdefault(r.word, set()).add(r.tag)
    args = (n, g, people, "none" if mode == "all" else "person", 85.0 if mode == "ner" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*args)
        for b in batches:
            texts, spans = b.column(b.schema.get_field_index(text)), b.column(b.schema.get_field_index(coref)) if coref else None
            start, chars, out, errors = 0, 0, [], []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                try:
                    found = spans[i].as_py() if coref and t else None
                    full = resolve_pronouns(t, [[(int(s["start"]), int(s["end"])) for s in c] for c in found]) if found is not None else t
                    out.append(tagger(full))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad text must not end the run
                    out.append(t or "")
                    errors.append(str(e))
                chars += len(t or "")
                if len(out) >= SLICE_ROWS or chars >= SLICE_CHARS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(out)).columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "tagged_text", "tag_error"])
                    start, chars, out, errors = i + 1, 0, [], []

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, tagged_text string, tag_error string")


def tag_names(text, names: dict[str, str]):
    """The whole-name step as an expression: each name, longest first, replaced by its tag. For short lists."""
    for n in sorted(names, key=lambda n: (-len(n), n)):
        text = F.regexp_replace(text, rf"(?i)\b{re.escape(n)}\b", names[n])
    return text


def tagged_sentences(df: DataFrame, text: str = "tagged_text") -> DataFrame:
    """A row for each sentence with sent_id, from 0."""
    return df.select("*", F.posexplode(sentences(F.col(text))).alias("sent_id", "sentence"))


def extract(tagged: DataFrame, gazetteer: DataFrame, text: str = "tagged_text", keep: list[str] | None = None, distinct: bool = False, name: str = "name_final", gender: str = "gender") -> DataFrame:
    """A row for each tag in each sentence (each different one with distinct): sentence, mp, gender and the columns to keep. Tags that nobody has go; of people with one tag the last by name wins. Blank genders are null."""
    people = _by_tag(gazetteer, name, gender)
    found = tags(F.col("sentence"))
    s = tagged_sentences(tagged, text).select(*(keep or []), "sent_id", "sentence", F.explode(F.array_distinct(found) if distinct else found).alias("_tag"))
    return s.join(people, "_tag").select(*(keep or []), "sent_id", "sentence", "_p.mp", "_p.gender")


def _by_tag(gazetteer: DataFrame, name: str, gender: str) -> DataFrame:
    person = F.struct(F.col(name).alias("mp"), F.nullif(F.trim(F.col(gender)), F.lit("")).alias("gender"))
    return gazetteer.groupBy(F.regexp_replace(tag_of(F.col(name)), "[<>]", "").alias("_tag")).agg(F.max(person).alias("_p"))


def mention_windows(tagged: DataFrame, gazetteer: DataFrame, width: int = 1, text: str = "tagged_text", keep: list[str] | None = None, name: str = "name_final", gender: str = "gender") -> DataFrame:
    """(keep, person, lo, hi, snippet): the windows of sentences around each sentence that mentions a person, clipped at the ends; a window counts once for a person and text.

    Windows are cut inside the text's own row: no sentence is shuffled to meet its neighbours. Only in texts of at most 2 width + 1 sentences can two windows be the same, so only there are they compared.
    """
    s = tagged.select(*(keep or []), sentences(F.col(text)).alias("_s"))
    n, lit = F.size("_s"), F.lit
    lo, hi = lambda i: F.greatest(i - width, lit(0)), lambda i: F.least(i + width, n - 1)
    found = F.transform("_s", lambda x, i: F.struct(lo(i).alias("lo"), hi(i).alias("hi"), F.array_distinct(tags(x)).alias("t")))
    found = F.filter(found, lambda w: F.size(w["t"]) > 0)
    pairs = F.flatten(F.transform(found, lambda w: F.transform(w["t"], lambda t: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), t.alias("t")))))
    pairs = F.when(n <= 2 * width + 1, F.array_distinct(pairs)).otherwise(pairs)
    whole = F.transform(pairs, lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"), w["t"].alias("t"), F.array_join(F.slice("_s", w["lo"] + 1, w["hi"] - w["lo"] + 1), " ").alias("snippet")))
    rows = s.select(*(keep or []), F.explode(whole).alias("w"))
    return rows.join(_by_tag(gazetteer, name, gender), F.col("w.t") == F.col("_tag")).select(*(keep or []), F.col("_p.mp").alias("person"), "w.lo", "w.hi", "w.snippet")
