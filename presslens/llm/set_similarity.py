"""SimHash near-duplicates at a wide radius, verified through tables of distances to reference fingerprints and by the exact similarity of sets of word shingles (operator 10 as the pipeline's stage uses it)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import few, slices, stored
from presslens.llm.simhash import fingerprint_of, references, shingle_hashes
from presslens.operators.components import connected_components

#: About so many documents tell which shingles are frequent. The order of shingles only decides how much work there is: any order finds every pair.
SAMPLE = 10_000
#: So many of the frequent shingles are sent to the tasks at most; the others count as rare.
FREQUENT = 100_000
#: With how many of a group its members are tried, round by round, before those still apart are tried with each other.
LEADERS = (1, 4)
#: Groups up to this size are tried in pairs at once.
SMALL = 16
#: Sets whose texts are held at once, twice, to verify pairs of them.
BLOCK = 2000
#: Pairs that a task remembers so as not to give them again.
GIVEN = 300_000
#: Bits of a number that holds a set's size and, in the lower ones, a shingle's place.
PLACE = 31


def shingle_set(text: str | None, k: int, seed: int) -> np.ndarray:
    """The different shingle hashes of the text, sorted."""
    return np.unique(shingle_hashes(text, k, seed))


def needed(n: int, least: float) -> int:
    """How many shingles of a set of n a set at least so similar shares with it."""
    return math.ceil(least * n - 1e-9)


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of the set, so many that two sets at least so similar have one of them in common. frequent is sorted; ties go by hash."""
    if not len(s):
        return s
    seen = np.zeros(len(s), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        seen = np.where(frequent[at] == s, counts[at], 0)
    return s[np.lexsort((s, seen))[: len(s) - needed(len(s), least) + 1]]


def frequent_shingles(docs: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that at least three of the sampled documents (doc_id, text) hold, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, k, seed) for t in b.column(0).to_pylist()]
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    share = docs.count() // SAMPLE + 1
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")
    top = sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.col("n").desc(), "s").limit(FREQUENT).toArrow()
    keys = top["s"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy()[order]


def signatures(docs: DataFrame, k: int, least: float, seed: int) -> DataFrame:
    """(doc_id, sig, n, fp, prefix) for every row: the hash of the text's set of shingles, its size, its fingerprint, its rarest shingles."""
    frequent, counts = frequent_shingles(docs, k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, k, seed) for t in b.column(1).to_pylist()]
            sig, fp = (np.array(x, np.uint64).view(np.int64) for x in ([_sig(s, seed) for s in sets], [fingerprint_of(s) for s in sets]))
            cols = [b.column(0), pa.array(sig), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), pa.array([prefix(s, frequent, counts, least).view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sig", "n", "fp", "prefix"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sig long, n long, fp long, prefix array<long>")


def _sig(shingles: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed)


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each value of the first column as one array of longs; rows come sorted by it."""
    kept: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        if kept and kept[-1][-1, 0] != rows[0, 0]:
            yield np.concatenate(kept)
            kept = []
        # of the rows, only those that share their value with a neighbour can matter, but for the last, which may go on
        same = rows[1:, 0] == rows[:-1, 0]
        stays = np.concatenate((same, [True])) | np.concatenate(([bool(kept)], same))
        rows = rows[stays]
        pieces = np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1)
        for p in pieces[:-1]:
            yield np.concatenate([*kept, p])
            kept = []
        kept.append(pieces[-1])
    if kept:
        yield np.concatenate(kept)


def distance_tables(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """table[r, x, b]: in how many bits of byte b fingerprint x differs from reference r."""
    x = refs[:, None] ^ np.ascontiguousarray(fp).view(np.uint64)[None, :]
    return np.bitwise_count(x.view(np.uint8).reshape(*x.shape, 8)).view(np.int8)


def undiscarded(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of two tables can be of fingerprints within the radius.

    In each byte a pair differs in at least as many bits as its two distances to any reference do. So the greatest of these differences, added up over the bytes, never exceeds the distance of the pair. Distances of whole fingerprints
    discard nothing at a wide radius: nearly all lie within 32 +- 8.
    """
    return np.abs(x - y).max(axis=0).sum(axis=1) <= radius


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, sig, n, at) for the tokens that different sets hold, each set once. Rows come as (token, sig, n and at in one number)."""
    out: list[np.ndarray] = []
    held = 0

    def emit() -> pa.RecordBatch:
        rows = np.concatenate([np.empty((0, 3), np.int64), *out])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[:, 0], rows[:, 1], rows[:, 2] >> PLACE, rows[:, 2] & ((1 << PLACE) - 1))], names=["token", "sig", "n", "at"])

    for g in sorted_groups(batches):
        g = g[np.unique(g[:, 1], return_index=True)[1]] if len(g) > 1 else g
        if len(g) > 1:
            out.append(g)
            held += len(g)
        if held >= 10_000:
            yield emit()
            out, held = [], 0
    yield emit()


def _near(radius: int, refs: np.ndarray):
    """From (a, b, fp_a, fp_b): the pairs (a, b) that the tables don't discard and whose fingerprints are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x, y = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (2, 3))
            near = np.flatnonzero(undiscarded(distance_tables(x, refs), distance_tables(y, refs), radius))
            yield b.select([0, 1]).take(pa.array(near[np.bitwise_count(x[near] ^ y[near]) <= radius]))

    return run


def _apart(least: float, radius: int, refs: np.ndarray):
    """From (token, root, sig, n, at, fp), sorted by token: the pairs (a, b) of sets of a token that have different roots, near fingerprints, and can be so similar if this is the first shingle they share.

    Pairs that could be so similar go through the tables; of those that aren't discarded the fingerprints are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        new: list[tuple[int, int]] = []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.int64()) for i in (0, 1)], names=["a", "b"])
            new.clear()
            return out

        for g in sorted_groups(batches):
            g = g[np.argsort(g[:, 1], kind="stable")]
            left, fp = g[:, 3] - g[:, 4], np.ascontiguousarray(g[:, 5]).view(np.uint64)
            table = distance_tables(fp, refs)
            ends = np.searchsorted(g[:, 1], g[:, 1], side="right")
            for i, end in enumerate(ends.tolist()):
                near = end + np.flatnonzero(np.minimum(left[end:], left[i]) >= least / (1 + least) * (g[end:, 3] + g[i, 3]) - 1e-9)
                if not len(near):
                    continue
                near = near[undiscarded(table[:, near], table[:, i : i + 1], radius)]
                near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
                x = int(g[i, 2])
                for y in g[near, 2].tolist():
                    pair = (x, y) if x < y else (y, x)
                    if pair not in given:
                        given.add(pair)
                        new.append(pair)
                if len(new) >= 10_000:
                    yield emit()
                if len(given) >= GIVEN:
                    given.clear()
        yield emit()

    return run


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, least: float, seed: int) -> DataFrame:
    """The pairs (a, b) of sets at least so similar. A set is made anew from a document that has it: reps is (sig, rep).

    Sets are dealt to blocks of about BLOCK; a pair is verified where its two blocks meet. So a text travels once for each block that it has a partner in, however many partners, and a task holds two blocks at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for b in slices(batches):
            out = []
            for i, j, a, other, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, j) != key:
                    key, held = (i, j), {}
                if other is None:
                    s = shingle_set(text, k, seed) if a not in held else None
                    if s is not None and int(np.uint64(_sig(s, seed)).view(np.int64)) == a:  # another text with the same doc_id, or without one, has another set
                        held[a] = s
                elif a in held and other in held:
                    x, y = held[a], held[other]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common >= least * (len(x) + len(y) - common) - 1e-9:
                        out.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    pairs = stored(pairs)
    n = pairs.count()
    blocks = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().count() // BLOCK + 1
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(blocks))
    dealt = pairs.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b")
    wanted = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = stored(wanted.join(reps, "sig").withColumnRenamed("rep", "_id"))
    texts = docs.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("_id"))).select("i", "j", F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = texts.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))
    rows = rows.repartition(n // 5000 + 1, "i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull())
    return rows.mapInArrow(run, "a long, b long")


def similar_links(own: DataFrame, reps: DataFrame, docs: DataFrame, k: int, least: float, radius: int, seed: int, refs: int = 16) -> DataFrame:
    """(a, b): links between different sets (column sig of own) that join all that are linked by pairs at least so similar.

    Sets meet under the shingles of their prefixes; the tables of distances to the references discard pairs whose fingerprints can't be within the radius, the fingerprints of the others are compared, and what is left is verified. While groups are large, their members are tried with a few of them; only sets that are
    still in different components are then tried in pairs, so that a large group of near copies costs about its size and no link that matters is left out.
    """
    spread = own.select(F.posexplode("prefix").alias("at", "token"), "sig", "n").select("token", "sig", (F.shiftleft("n", PLACE) + F.col("at")).alias("n_at"))
    shared = spread.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "token long, sig long, n long, at long")
    shared = stored(shared.join(own.groupBy("sig").agg(F.first("fp").alias("fp")), "sig").select("token", "sig", "n", "at", "fp"))

    links = shared.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    tried, pending = links, shared.withColumn("root", F.col("sig"))

    def enough(a: str, b: str) -> Column:
        # what is left of either set from the shingle on has to be enough: so it is at the first one that a similar pair shares
        left, both = F.least(F.col(f"n{a}") - F.col(f"at{a}"), F.col(f"n{b}") - F.col(f"at{b}")), F.col(f"n{a}") + F.col(f"n{b}")
        return left >= F.lit(least / (1 + least)) * both - 1e-9

    # the text that others are copies of has more shingles in common with them than a copy, which has some of its own: it leads
    common = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n_token"))
    weight = stored(shared.join(common, "token").groupBy("sig").agg(F.sum("n_token").alias("weight")))
    pending = pending.join(few(weight), "sig")
    for most in LEADERS:
        if pending.groupBy("token").count().where(F.col("count") > SMALL).isEmpty():
            break
        order = Window.partitionBy("token").orderBy(F.col("weight").desc(), "sig")  # one order for all groups, so that groups that overlap have the same first members
        lead = pending.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= most).select("token", F.col("sig").alias("lead"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
        pairs = pending.join(lead, "token").where("root != root_b").where(enough("", "_b")).select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b"), "fp", "fp_b")
        pairs = pairs.mapInArrow(_near(radius, references(refs)), "a long, b long").distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(verified(pairs, reps, docs, k, least, seed)))
        tried = tried.unionByName(pairs)
        roots = connected_components(links).withColumnRenamed("node", "sig").withColumnRenamed("root", "found")
        rooted = pending.drop("root").join(roots, "sig", "left").select("token", "sig", "n", "at", "fp", "weight", F.coalesce("found", "sig").alias("root"))
        apart = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
        pending = stored(rooted.join(apart, "token", "left_semi"))
    spread = pending.select("token", "root", "sig", "n", "at", "fp").repartition("token").sortWithinPartitions("token")
    pairs = spread.mapInArrow(_apart(least, radius, references(refs)), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(verified(pairs, reps, docs, k, least, seed))


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", refs: int = 16) -> DataFrame:
    """(doc_id, component_id) for every row of docs; component_id is the smallest doc_id reachable by links, its own included.

    Texts link if their fingerprints (SimHash of the set of k-word shingles) differ in at most ``radius`` bits and the Jaccard similarity of these sets is at least ``similarity``; shingles are those of op10's fingerprints. At a similarity
    of 0.8 fingerprints differ in about ten bits with a deviation of three, in a few more where sets are very small: the radius is four deviations beyond. Pairs are tried through tables of distances to ``refs`` reference fingerprints, which lose none. Texts without words link with each other. Rows without a doc_id
    take part and get the smallest doc_id of their group, null if none has one; rows that repeat are one node; other columns are ignored; an empty table gives an empty one.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = stored(signatures(named, k, similarity, seed))
    reps = stored(own.groupBy("sig").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(similar_links(own, reps, named, k, similarity, radius, seed, refs))
    rooted = stored(reps.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own.select("doc_id", "sig").join(rooted.join(smallest, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")
