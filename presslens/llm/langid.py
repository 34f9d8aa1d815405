"""Language identification by compression (operator 8)."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presslens.llm.common import given_back, set_aside, slices, stored, text_beside

UNDETERMINED = "und"
#: Normal texts of fewer bytes are compressed by dictionaries of parts of the samples too: sizes are whole bytes, of which a short text has too few to tell languages apart.
SHORT, PARTS = 1024, 4


def held_out(doc_id: Column) -> Column:
    """The documents that no classifier learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def normal(text: str) -> bytes:
    """What is compressed: lower-case letters and the spaces between words. Marks, digits and markup say nothing of a language."""
    return (" " + " ".join(NOT_WORD.sub(" ", text.lower()).split()) + " ").encode("utf-8")


NOT_WORD = re.compile(r"[\W\d_]+")


class Compressors:
    """For each language a compressor whose dictionary is raw text of that language, and some with parts of it."""

    def __init__(self, samples: dict[str, bytes], level: int) -> None:
        self.languages = list(samples)
        self.whole = [self._one(x, level) for x in samples.values()]
        self.parts = [[self._one(x[len(x) * k // PARTS : len(x) * (k + 1) // PARTS], level) for x in samples.values()] for k in range(PARTS)]

    @staticmethod
    def _one(sample: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str, piece: int) -> np.ndarray:
        """Compressed bytes of the whole text by each dictionary; of a short text the sum over those of the parts too. Each piece is compressed by itself, so that the dictionary counts throughout and not only until the text is its own best dictionary."""
        raw = normal(text)
        out = np.zeros(len(self.languages))
        for start in range(0, len(raw), piece):
            part = raw[start : start + piece]
            out += [len(c.compress(part)) for c in self.whole]
        if len(raw) < SHORT:
            for compressors in self.parts:
                out += [len(c.compress(raw)) for c in compressors]
        return out


class Classifier:
    """samples: language -> raw text of it, the most frequent language first: it wins ties. margin: the share by which the smallest size must undercut the next."""

    def __init__(self, samples: dict[str, bytes], level: int = 3, piece: int = 4096, margin: float = 0.002) -> None:
        self.samples, self.level, self.piece, self.margin = samples, level, piece, margin
        self._made: Compressors | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score rises from 0 (a tie) towards 1 with the margin; und has score 0 and is rejected."""
        if not text or not self.samples or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        self._made = self._made or Compressors(self.samples, self.level)
        sizes = self._made.sizes(text, self.piece)
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else np.inf
        gap = 1.0 if len(order) == 1 else float((second - best) / second)
        return self._made.languages[order[0]], min(1.0, gap * 4), gap < self.margin


def fit(docs: DataFrame, bytes_per_language: int = 250_000, docs_per_language: int = 256, languages: int = 500, chars_per_doc: int = 4096, level: int = 3, piece: int = 4096, margin: float = 0.002, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Learn from labelled documents that aren't held out: of each of the ``languages`` most frequent ones at most docs_per_language documents, spread over all by the hash of their id, the first chars_per_doc characters of each, and bytes_per_language of their normal text.

    These are the bounds of the sample; nothing else is bounded, and predictions read whole texts.

    The sample takes one grouped minimum over ids, and then a scan for the chosen ids. Rows with a null id, text or language teach nothing; a language with no text is not learned.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(8))
    drawn = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), h.alias("h")).groupBy("lang", F.pmod("h", F.lit(docs_per_language)).alias("k")).agg(F.min_by("doc_id", "h").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    drawn = stored(drawn)
    frequent = drawn.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).select("lang")
    drawn = drawn.join(F.broadcast(frequent), "lang")
    by_language: dict[str, list] = {}
    seen: dict[str, int] = {}
    for r in drawn.toLocalIterator():
        by_language.setdefault(r.lang, []).append(r.doc_id)
        seen[r.lang] = seen.get(r.lang, 0) + r.n
    ids = sorted({i for x in by_language.values() for i in x})
    if not ids:
        return Classifier({}, level, piece, margin)
    texts = labelled.where(F.col(id_col).isin(ids)).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("doc_id"), F.substring(text_col, 1, chars_per_doc).alias("text"))
    kept: dict[str, dict[str, bytes]] = {}
    for r in texts.toLocalIterator():
        kept.setdefault(r.lang, {})[r.doc_id] = normal(r.text)
    samples = {}
    for language, found in sorted(kept.items(), key=lambda x: (-seen[x[0]], x[0])):
        most, parts, size = bytes_per_language, [], 0
        for _, raw in sorted(found.items(), key=lambda x: zlib.crc32(x[0].encode())):
            if len(raw) > 2 and size < most:
                parts.append(raw[: most - size])
                size += len(parts[-1])
        if size:
            samples[language] = b"".join(parts)
    return Classifier(samples, level, piece, margin)


def predict(docs: DataFrame, classifier: Classifier, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected. Only the text is used, whole. Columns of docs with these names are replaced.

    Null texts and texts without a letter are ``und``, rejected; so is every text if nothing was learned. A narrow margin rejects too, but the nearest language is still named. Nothing is shuffled.
    """
    found, own = _predicted(docs, classifier, text_col, *names)
    return found.select(*given_back(own), *[F.col(c).alias(n) for c, n in zip(NEW, names, strict=True)])


def drop_rejected(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The documents whose language predict() doesn't reject, with the columns of docs."""
    found, own = _predicted(docs, classifier, text_col)
    return found.where("NOT rejected").select(*given_back(own))


#: The columns that predictions add.
NEW = ("lang_pred", "score", "rejected")


def _predicted(docs: DataFrame, classifier: Classifier, text_col: str, *replaced: str) -> tuple[DataFrame, dict[str, str]]:
    rows, own = set_aside(docs, *replaced)
    rows, place = text_beside(docs, rows, own, text_col)
    schema = rows.select(*own.values()).schema
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in slices(batches):
            found = [c.predict(t.as_py()) for t in b.column(place)]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *new], names=[*own.values(), *NEW])

    fields = [*schema.fields, *StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean").fields]
    return rows.mapInArrow(run, StructType(fields)), own
