"""Benchmark decontamination by SimHash over windows of an item's size (operator 6)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from presslens.llm.common import given_back, set_aside, slices, stored, text_beside

#: Items of the benchmark, and bytes of their texts, that are held, sent and searched for at once; more go through the documents in further blocks.
BLOCK, BLOCK_BYTES = 20_000, 16_000_000
#: Words whose numbers a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Windows of one text that are fingerprinted at once.
AT_ONCE = 2048


def words_of(text: str | None) -> list[str]:
    """Lower-case words with no punctuation around them."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


#: What may stand around a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‘’‚“”„…–—¿¡"


def shingles(words: list[str], k: int) -> list[str]:
    """All k-word shingles in order; the whole sequence if there are fewer words."""
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) > k else [" ".join(words)] if words else []


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (a.total() + b.total() - both) if both else 0.0


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words), 42)


class Index:
    """The items' fingerprints, with a table of each 8-bit block of them."""

    def __init__(self, items: list[tuple[object, str]], k: int, radius: int) -> None:
        self.k, self.radius = k, radius
        self.slack = radius // 8  # eight blocks: within the radius, one block differs by at most this many bits
        self.bags, self.ids, self.sizes = [], [], []
        self.by_size: dict[int, list[int]] = defaultdict(list)
        first: dict[str, set[int]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            if w:
                bag = Counter(shingles(w, k))
                self.by_size[len(w)].append(len(self.ids))
                for s in bag:
                    first[s].add(len(w))
                self.ids.append(item)
                self.sizes.append(len(w))
                self.bags.append(bag)
        self.known = {w for s in first for w in s.split(" ")}
        self.number = {w: n + 1 for n, w in enumerate(sorted(self.known))}
        #: For each number of words in a shingle: its codes, and for each size of an item the codes of such items.
        self.codes: dict[int, np.ndarray] = {}
        self.codes_of: dict[int, np.ndarray] = {}
        for n in self.by_size:
            self.codes_of[n] = np.unique(np.array([self._code(s) for s, at in first.items() if n in at], np.uint64))
        for width in {min(k, n) for n in self.by_size}:
            self.codes[width] = np.unique(np.concatenate([c for n, c in self.codes_of.items() if min(k, n) == width]))
        self.fp = {n: np.array([fingerprint(self.bags[i]) for i in at], np.uint64) for n, at in self.by_size.items()}
        self.blocks = {n: [self._lists((fp >> np.uint64(8 * b)) & np.uint64(255)) for b in range(8)] for n, fp in self.fp.items()}
        self.numbers = _Numbers(self.number)

    def _code(self, s: str) -> int:
        words = s.split(" ")
        return int(rolling(np.array([self.number[w] for w in words], np.uint64), len(words))[0])

    def _lists(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, items): items[starts[v] : starts[v + 1]] are the items whose value of the block is within the slack of v."""
        near = np.bitwise_count(block[None, :] ^ np.arange(256, dtype=np.uint64)[:, None]) <= self.slack
        return np.concatenate(([0], np.cumsum(near.sum(axis=1)))), np.nonzero(near)[1].astype(np.int32)

    def candidates(self, n: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) positions of the items of size n within the radius of each fingerprint: those that some block's list for the window's value holds, and that the distance confirms."""
        windows, items = [], []
        for b, (starts, lists) in enumerate(self.blocks[n]):
            v = ((fps >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            many = starts[v + 1] - starts[v]
            window = np.repeat(np.arange(len(fps)), many)
            item = lists[np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[v], many)]
            near = np.bitwise_count(self.fp[n][item] ^ fps[window]) <= self.radius
            windows.append(window[near])
            items.append(item[near])
        met = np.unique(np.concatenate(windows) * len(self.fp[n]) + np.concatenate(items))
        return met // len(self.fp[n]), np.array(self.by_size[n])[met % len(self.fp[n])]


class _Numbers(dict):
    """The number of a raw lower-case word: that of the word without the punctuation around it, 0 if no item has it, -1 if nothing is left."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, raw: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        word = raw.strip(EDGES)
        n = self[raw] = self.number.get(word, 0) if word else -1
        return n


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def rolling(numbers: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """A number for the k word numbers from each place on (modulo 2^64); equal runs have equal numbers."""
    at = np.arange(max(0, len(numbers) - k + 1)) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[at + j] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return out


def fingerprint(bag: Counter) -> int:
    """The SimHash of a weighted bag of shingles."""
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in bag], np.uint64)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    on = (2 * (bits * np.array(list(bag.values()))[:, None]).sum(axis=0) > bag.total()).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of the n shingles from each start on, by differences of running sums of the bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    on = (2 * (sums[starts + n] - sums[starts]) > n).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)


def find(text: str | None, index: Index, similarity: float) -> dict[int, tuple[float, int]]:
    """item position: (best similarity, first word of that window) for each item that some window of the text matches.

    For every size n of an item the windows are the runs of n words (the whole text if it is shorter). A window that shares no shingle with any item has similarity zero to all
    and is passed over before its fingerprint is made; all others are fingerprinted, looked up, and verified exactly.
    """
    found: dict[int, tuple[float, int]] = {}
    numbers = np.fromiter(map(index.numbers.__getitem__, (text or "").lower().split()), np.int64)
    numbers = numbers[numbers >= 0].astype(np.uint64)
    length = len(numbers)
    known = np.concatenate(([0], np.cumsum(numbers > 0)))
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by the words in a shingle: where a shingle of an item may start, and its code
    for width, codes in index.codes.items():
        at = np.flatnonzero(known[width:] - known[:-width] == width) if length >= width else np.empty(0, np.int64)
        if len(at):
            code = rolling(numbers, width, at)
            mine = among(code, codes)
            at, code = at[mine], code[mine]
        if len(at):
            hits[width] = at, code
    if not hits:
        return found
    words = words_of(text)
    for n in index.by_size:
        k = min(index.k, n)
        if k not in hits:
            continue
        at, code = hits[k]
        at = at[among(code, index.codes_of[n])]
        size = min(n, length)
        per = size - k + 1  # shingles of a window
        last = length - size
        mark = np.zeros(last + 2, np.int64)  # windows that hold a hit: starts from hit - per + 1 to hit
        np.add.at(mark, np.clip(at - per + 1, 0, last + 1), 1)
        np.add.at(mark, np.clip(at + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
        for lo in range(0, len(starts), AT_ONCE):
            some = starts[lo : lo + AT_ONCE]
            for run in np.split(some, np.flatnonzero(np.diff(some) > size) + 1):  # stretches that overlap
                base = int(run[0])
                stretch = words[base : int(run[-1]) + size]
                hashes = np.array([_hash(stretch[i : i + k]) for i in range(len(stretch) - k + 1)], np.uint64)
                for w, i in zip(*(x.tolist() for x in index.candidates(n, window_fingerprints(hashes, run - base, per))), strict=True):
                    start = int(run[w])
                    s = weighted_similarity(index.bags[i], Counter(shingles(words[start : start + size], k)))
                    if s >= similarity and s > found.get(i, (0.0, 0))[0]:
                        found[i] = (s, start)
    return found


def benchmark_blocks(benchmark: DataFrame, block: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items, ``block`` of them or ``most_bytes`` of text at a time (one item at least): however many there are, the driver and a task hold only so many."""
    held: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        if held and (len(held) == block or size + len(r[1].encode()) > most_bytes):
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1].encode())
    if held:
        yield held


def _searched(docs: DataFrame, benchmark: DataFrame, k: int, similarity: float, radius: int, block: int, text_col: str, *replaced: str) -> tuple[DataFrame, dict[str, str]]:
    """docs as set_aside() renames it with the columns of matches().

    Each block of items is a pass over the documents; with several, what was found is written to the shared folder after each, so that a task holds one block's index.
    """
    rows, own = set_aside(docs, *replaced)
    rows, place = text_beside(docs, rows, own, text_col)
    before = len(rows.columns)
    item = benchmark.schema["item_id"].dataType
    new = StructType().add("item_ids", ArrayType(item)).add("similarities", ArrayType(DoubleType())).add("positions", ArrayType(IntegerType()))
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def search(items: list[tuple[object, str]]):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, k, radius)
            for b in slices(batches):
                found = []
                for t, *known in zip(b.column(place), *(b.column(i).to_pylist() for i in range(before, b.num_columns)), strict=True):
                    here = sorted(((index.ids[i], s, at) for i, (s, at) in find(t.as_py(), index, similarity).items()), key=lambda x: (x[0] is not None, x[0], x[2]))
                    found.append([x + [h[j] for h in here] for j, x in enumerate(known)])
                yield pa.RecordBatch.from_arrays([*b.columns[:before], *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], names=b.schema.names)

        return run

    out = rows.select("*", *[F.array().cast(f.dataType).alias(f.name) for f in new.fields])
    schema = StructType([*rows.schema.fields, *new.fields])
    blocks = benchmark_blocks(benchmark, block)
    items = next(blocks, None)
    while items:
        out = out.mapInArrow(search(items), schema)
        if items := next(blocks, None):
            out = stored(out)
    return out, own


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 20, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """docs with item_ids (those whose passage the text holds), similarities and positions (the first word of the best window of each).

    A passage matches at a weighted Jaccard similarity of at least ``similarity`` of k-word shingles between the item and a window of as many words. Fingerprints of such windows
    differ in about ten bits; the radius of 20 bits is 3.5 standard deviations beyond. Case, white space and the punctuation around words don't count. Each text is searched whole, on its own: no shuffle, no hot key.
    Null and empty texts hold nothing; null and empty items match nothing; items of fewer than k words match as one shingle; repeated rows are searched each; an empty benchmark matches nothing, empty docs stay empty.
    Columns of docs with the new names are replaced, any other name may be used. item_id may be of any type that has an order.
    """
    new = ("item_ids", "similarities", "positions")
    out, own = _searched(docs, benchmark, k, similarity, radius, block, text_col, *new)
    return out.select(*given_back(own), *new)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 20, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """The documents that hold no passage of the benchmark, with the columns of docs."""
    out, own = _searched(docs, benchmark, k, similarity, radius, block, text_col)
    return out.where(F.size("item_ids") == 0).select(*given_back(own))
