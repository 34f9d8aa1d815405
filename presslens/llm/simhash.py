"""SimHash near-duplicates, verified through tables of distances to reference fingerprints (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import few, given_back, renamed, set_aside, slices, split_hot, stored
from presslens.operators.components import connected_components
from presslens.session import checkpointed

BITS = 64
#: Rows that a task compares: they are few bytes but take long, so their number decides on tasks, not their size.
ROWS = 25_000
#: Shingle hashes whose bits are counted at once; longer texts are counted slice by slice.
SLICE = 1 << 15


def shingle_hashes(text: str | None, k: int, seed: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the text with A-Z lowered, repeats included; of all words if they are fewer than k."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, and the separators are those of WORD
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[i:j], seed) for i, j in zip(starts[: -k + 1 or None].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, how often each of the 64 bits is set (the lowest first)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32).astype(np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of one list of hashes."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        sums += bit_sums(hashes[at : at + SLICE], np.zeros(1, np.int64))[0]
    return int(np.packbits((2 * sums > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints_of(texts: list[str | None], k: int = 4, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes. A text without words has fingerprint zero."""
    counts, sizes = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            lengths = [len(x) for _, x in held]
            sums = bit_sums(np.concatenate([x for _, x in held]), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64))
            np.add.at(counts, [i for i, _ in held], sums)
        held.clear()
        n = 0

    for i, t in enumerate(texts):
        h = shingle_hashes(t, k, seed)
        sizes[i] = len(h)
        for at in range(0, len(h), SLICE):
            held.append((i, h[at : at + SLICE]))
            n += len(held[-1][1])
            if n >= SLICE:
                flush()
    flush()
    on = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row: the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints_of(b.column(1).to_pylist(), k, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def references(n: int) -> np.ndarray:
    """n reference fingerprints: the XXH64 of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), 0) for i in range(n)], np.uint64)


def block_masks(n: int, radius: int, group: int = 2048) -> list[int]:
    """Masks of bits such that two fingerprints within the radius agree on at least one mask.

    Of m blocks at most ``radius`` hold a difference, so some m - radius blocks agree whole: one mask for each choice of them. m grows with
    the number n of fingerprints until about ``group`` share a mask's value by chance, so that work stays near-linear in n.
    """
    for m in range(radius + 1, radius + 5):
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        blocks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(m)]
        masks = [sum(blocks[i] for i in c) for c in combinations(range(m), m - radius)]
        if n / 2.0 ** min(x.bit_count() for x in masks) <= group:
            break
    return masks


class Forest:
    """Union-find over positions that keeps only the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        """i is linked with each of the others."""
        roots = self.root[others]
        if (roots == self.root[i]).all():
            return
        for r, at in zip(*np.unique(roots, return_index=True), strict=True):
            if r != self.root[i]:
                self.links.append((i, int(others[at])))
                self.root[self.root == r] = self.root[i]


def near_links(fp: np.ndarray, part: np.ndarray, i: int, j: int, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of positions within the radius. If i != j, only pairs of different parts count.

    table[x, r] is the distance from x to reference r. |table[x, r] - table[y, r]| never exceeds the distance of x and y, so a pair that differs
    by more than the radius in any coordinate is discarded; the rest is verified.
    """
    order = np.argsort(part, kind="stable")
    left, right = (np.flatnonzero(part == i), np.flatnonzero(part == j)) if i != j else (order, order)
    if not len(left) or not len(right):
        return []
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    right = right[np.argsort(table[right, 0], kind="stable")]
    first = table[right, 0]
    forest = Forest(len(fp))
    for x in left.tolist():
        lo, hi = np.searchsorted(first, [table[x, 0] - radius, table[x, 0] + radius + 1])
        near = right[lo:hi]
        for r in range(1, len(refs)):
            if len(near) < 4:
                break
            near = near[np.abs(table[near, r] - table[x, r]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
        if len(near) > 1 or len(near) == 1 and near[0] != x:
            forest.join(x, near)
    return forest.links


def _search(radius: int, n_refs: int):
    refs = references(n_refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # of the group that may go on in the next batch

        def solve(rows: np.ndarray) -> list[tuple[int, int]]:
            fp = rows[:, 4].view(np.uint64)
            links = near_links(fp, rows[:, 3], int(rows[0, 1]), int(rows[0, 2]), radius, refs)
            return [(int(rows[a, 4]), int(rows[b, 4])) for a, b in links]

        def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def groups() -> Iterator[np.ndarray]:
            nonlocal kept
            for b in batches:
                if not b.num_rows:
                    continue
                rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], axis=1)
                at = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
                if kept and (rows[0, :3] != kept[0][0, :3]).any():
                    yield np.concatenate(kept)
                    kept = []
                pieces = np.split(rows, at)
                if len(pieces) > 1:
                    yield np.concatenate([*kept, pieces[0]])
                    yield from pieces[1:-1]
                    kept = [pieces[-1]]
                else:
                    kept.append(pieces[0])
            if kept:
                yield np.concatenate(kept)

        out: list[tuple[int, int]] = []
        for rows in groups():
            if len(rows) > 1:
                out += solve(rows)
            if len(out) >= 10_000:
                yield emit(out)
                out = []
        yield emit(out)

    return run


def hamming_links(fps: DataFrame, radius: int = 4, refs: int = 16, hot: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints (column fp) within the radius.

    Fingerprints that agree on a mask of block_masks() meet in a task, which lets through only pairs that the distance tables can't discard and verifies them.
    No link is lost; of the links inside a task those that close a circle are left out, so that the output grows with the fingerprints, not with their pairs.
    A mask value shared by more than ``hot`` fingerprints is dealt to several tasks.
    """
    n = fps.count()
    masks = block_masks(n, radius)
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    dealt = split_hot(fps.select("fp", F.explode(keys).alias("key")), ["key"], F.col("fp"), hot)
    dealt = dealt.select("key", "task_i", "task_j", "part", "fp").repartition(n * len(masks) // ROWS + 1, "key", "task_i", "task_j").sortWithinPartitions("key", "task_i", "task_j")
    return dealt.mapInArrow(_search(radius, refs), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, seed: int = 42, refs: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable by links, its own included.

    Fingerprints link at ``radius`` or fewer differing bits. Null and empty texts have fingerprint zero, linked like any other. Rows
    without a doc_id take part and get the smallest doc_id of their group, null if none has one. Other columns of docs are ignored.
    """
    own = checkpointed(fingerprints(docs, k, seed, id_col, text_col))
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(hamming_links(classes.select("fp"), radius, refs))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_smallest(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one document of each group of found (doc_id, component_id): that with the smallest doc_id, and of rows that repeat that id the first by content. Rows without a doc_id stay.

    The texts of ids that don't repeat, nearly all, aren't shuffled unless the ids that stay are too many to broadcast.
    """
    keep = stored(found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    rows, own = set_aside(docs)
    rows = rows.withColumn("own_id", F.col(renamed(docs, id_col))).withColumn("text", F.col(renamed(docs, text_col)).cast("string"))
    placed = rows.join(few(keep), F.col("own_id") == F.col("id"))
    order = Window.partitionBy("id").orderBy(F.xxhash64("text"), F.col("text"))
    first = placed.where("n > 1").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    kept = [x.select(*given_back(own)) for x in (placed.where("n = 1"), first, rows.where("own_id IS NULL"))]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def drop_near_duplicates(docs: DataFrame, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group, see keep_smallest(): groups of near_duplicates() or, if a similarity is given, of set_similarity.similar_documents()."""
    if similarity is None:
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    else:
        from presslens.llm.set_similarity import similar_documents

        found = similar_documents(docs, similarity=similarity, id_col=id_col, text_col=text_col, **options)
    return keep_smallest(docs, found, id_col, text_col)
