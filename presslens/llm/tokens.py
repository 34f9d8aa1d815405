"""Token counts and ids by a byte-level BPE vocabulary, with a shortcut for strings that are one token (operator 2)."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: how byte-level BPE vocabularies cut a text into pre-tokens. White_Space, not the module's own class for white space, is what the tokenizer libraries use.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of the code points below U+0250 alone, for the quicker standard module.
LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: White space other than space and line feed.
RARE_SPACE = re.compile(r"[^\S \n]")
#: Letters on which all libraries agree: a run of them after a space is one pre-token.
LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
#: Strings whose tokens a worker remembers; beyond it the memory starts anew, which changes the speed and not the result.
REMEMBERED = 1_000_000


def byte_letters() -> dict[int, str]:
    """Fixed: the letter that stands for each byte in a byte-level vocabulary. Printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}


class Merger:
    """The merges of a vocabulary file, the lowest rank first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of = {c: bytes([b]) for b, c in letters.items()}
        raw = lambda s: b"".join(of[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (n, self.ids[raw(a + b)]) for n, (a, b) in enumerate(pairs)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.whole = self._prove()

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.single[b] for b in piece]
        ranks = self.ranks
        while len(ids) > 1:
            best = min((ranks.get(p, _NEVER) for p in zip(ids, ids[1:])), default=_NEVER)
            if best is _NEVER:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _prove(self) -> dict[str, int]:
        """The strings of the vocabulary that are a pre-token of their own and that the merges turn into one token, with its id."""
        out = {}
        for raw, i in self.ids.items():
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if PRE_TOKEN.fullmatch(text) and PRE_TOKEN.findall(text) == [text] and self.merge(raw) == [i]:
                out[text] = i
        return out


_NEVER = (1 << 60, -1)


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """One for each worker and file."""
    return Merger(path)


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(text) if BEYOND_LATIN.search(text) else LATIN.findall(text)


class _Ids(dict):
    """The ids of " " + chunk, as bytes, made when first asked for: a proven string is looked up, the rest is merged."""

    def __init__(self, m: Merger) -> None:
        self.m, self.rest = m, compiled_merges(m)

    def pieces(self, text: str) -> list[int]:
        ids: list[int] = []
        for p in pre_tokens(text):
            one = self.m.whole.get(p)
            if one is not None:
                ids.append(one)
            else:
                ids += self.rest(p.encode("utf-8"))
        return ids

    def made(self, chunk: str):
        text = " " + chunk
        one = self.m.whole.get(text)
        if one is not None:
            return [one]
        return self.rest(text.encode("utf-8")) if LETTERS.fullmatch(chunk) else self.pieces(text)

    def value(self, chunk: str):
        return array("I", self.made(chunk)).tobytes()

    def __missing__(self, chunk: str):
        if len(self) > REMEMBERED:
            self.clear()
        found = self.value(chunk)
        if len(chunk) < 64:
            self[chunk] = found
        return found


class _Counts(_Ids):
    """How many they are."""

    def value(self, chunk: str) -> int:
        return len(self.made(chunk))


def compiled_merges(m: Merger):
    """Merger.merge in compiled code. That merges by the id of what two parts make, which is the same where ids rise with the ranks."""
    made = [i for _, i in sorted(m.ranks.values())]
    if made != sorted(made):
        return m.merge
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=m.ids, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """The token ids of whole texts as the tokenizers library gives them without added special tokens; special strings inside a text are special tokens, the library's default."""

    def __init__(self, path: str) -> None:
        self.m = merger(path)
        self.ids, self.counts = _Ids(self.m), _Counts(self.m)
        self.special = re.compile("|".join(map(re.escape, sorted(self.m.special, key=len, reverse=True)))) if self.m.special else None

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """The text cut at spaces where no pre-token goes on: those without white space beside them."""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or RARE_SPACE.search(text):
            return re.split(r"(?<=\S) (?=\S)", text)
        return text.split(" ")

    def _segments(self, text: str) -> Iterator[str | int]:
        """The text between special strings, and their ids."""
        at = 0
        for s in self.special.finditer(text) if self.special else ():
            yield text[at : s.start()]
            yield self.m.special[s[0]]
            at = s.end()
        yield text[at:]

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        for x in self._segments(text or ""):
            if isinstance(x, int):
                out.append(array("I", [x]).tobytes())
            elif x:
                first, *rest = self._chunks(x)
                out.append(array("I", self.ids.pieces(first)).tobytes())
                out += map(self.ids.__getitem__, rest)
        return np.frombuffer(b"".join(out), "<u4")

    def count(self, text: str | None) -> int:
        n = 0
        for x in self._segments(text or ""):
            if isinstance(x, int):
                n += 1
            elif x:
                first, *rest = self._chunks(x)
                n += len(self.ids.pieces(first)) + sum(map(self.counts.__getitem__, rest))
        return n


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs: its whole text, without begin or end tokens, cut-off or padding.

    vocabulary is the path of a byte-level BPE .json file, which every executor must have. Null and empty texts have no bytes and no tokens. Nothing is
    shuffled; a worker remembers at most REMEMBERED strings. Other columns of docs are ignored, rows that repeat are counted one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.fromiter((e.count(t) for t in texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8")) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
