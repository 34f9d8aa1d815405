"""Embedding near-duplicates by an exact metric range join (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import stored
from presslens.llm.simhash import Forest
from presslens.operators.components import connected_components

#: Labels of more vectors than this are dealt to cells, at least two.
WHOLE = 16
#: At most so many numbers of pivots (and one pivot a label) are sent to the executors, however many vectors there are; cells are larger then, and split.
PIVOT_NUMBERS = 4_000_000
#: Cosines this near to the threshold are computed again, as a quotient.
EDGE = 1e-9


def usable(vector: str) -> F.Column:
    """Not null or empty, every component finite, not all zero."""
    v = F.col(vector)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, cell: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Two vectors link if their labels and lengths are equal and their cosine is at least the threshold, that is, if the distance of the unit vectors is at most tau = sqrt(2 - 2 threshold).
    A label of n > WHOLE vectors gets n / ``cell`` pivots, at least two, drawn from its own vectors; each vector lives in the cell of its nearest pivot. By the triangle inequality a vector x of cell h can have a partner in cell j only if
    (d(x, j) - d(x, h)) / 2 <= tau, sharpened for Euclidean distance to (d(x, j)^2 - d(x, h)^2) / (2 d(h, j)) <= tau; it is copied to those cells j < h, so that each pair meets in one cell and cells join on their own.
    Equal vectors are one row with a count before that. A cell of more than ``cell`` residents is split; residents are held in memory, visitors stream past. Links are counted in full, but of their pairs
    only a spanning forest leaves a task, so groups of copies stay linear. Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or vec_id, link with nothing.
    kept is true for a null vec_id. n_links counts rows; an empty table gives an empty one; other columns are ignored. Rows that repeat a vec_id with another vector count as one node of a component.
    """
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v")
    v = v.withColumn("h1", F.when(ok, F.xxhash64("label", "v"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit("second"), "v", "label")))
    classes = stored(v.where(F.col("h1").isNotNull()).groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")))
    found = stored(_join(classes, threshold, cell, "float" in dict(vectors.dtypes)[vector_col]))
    counts = found.where("other IS NULL").groupBy("rep", "h1").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other IS NOT NULL").select("rep", "other"), "rep", "other").withColumnRenamed("node", "rep")
    named = classes.select("label", "h1", "h2", "rep", "mult").join(counts.withColumnRenamed("h1", "_h1").withColumnRenamed("rep", "_rep"), (F.col("rep") == F.col("_rep")) & (F.col("h1") == F.col("_h1")), "left")
    named = named.join(roots, "rep", "left").select(F.col("label").alias("_l"), F.col("h1").alias("_a"), F.col("h2").alias("_b"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = v.drop("v").join(named, (F.col("label") == F.col("_l")) & (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pivots(classes: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """Unit vectors for each label and length with more than WHOLE vectors: their number is the label's share of the vectors."""
    sized = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE)
    p = F.greatest(F.lit(2), F.ceil(F.col("n") / F.lit(float(cell))))
    numbers = sized.agg(F.sum(p * F.col("dim")).alias("x")).first().x or 0
    p = F.greatest(F.lit(2), F.floor(p * min(1.0, PIVOT_NUMBERS / max(numbers, 1)))).cast("long")
    sized = sized.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), p.alias("p"))
    drawn = classes.join(sized, (F.col("label") == F.col("_l")) & (F.size("v") == F.col("_d")))
    drawn = drawn.groupBy("label", F.size("v").alias("dim"), F.pmod("h2", F.col("p")).alias("k")).agg(F.min_by("v", "h2").alias("v"))
    out: dict[tuple, list] = {}
    size = 0
    for r in drawn.orderBy("dim", "k", "label").toLocalIterator():
        if size + r.dim > 4 * PIVOT_NUMBERS and (r.label, r.dim) not in out:
            continue  # so many labels that each having pivots is too much: the others are one cell, split into parts
        out.setdefault((r.label, r.dim), []).append(r.v)
        size += r.dim
    return {k: _unit(np.array(x)) for k, x in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _join(classes: DataFrame, threshold: float, cell: int, single: bool) -> DataFrame:
    """(rep, h1, n, other): rows with a null other add n to the links of the class (rep, h1); the others are links between classes, a spanning forest of each task's."""
    pivots = _pivots(classes, cell)
    kind, label_kind = dict(classes.dtypes)["rep"], dict(classes.dtypes)["label"]
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    tau = math.sqrt(2 - 2 * threshold) + EDGE
    number = np.dtype("f4" if single else "f8")  # as in the table, so that copies take no more than they have to

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, vs = b.column(0).to_pylist(), b.column(4)
            starts, flat = vs.offsets.to_numpy(), vs.values.to_numpy(zero_copy_only=False)
            dims = np.diff(starts)
            groups: dict[tuple, list[int]] = {}
            for i, (label, d) in enumerate(zip(labels, dims.tolist(), strict=True)):
                groups.setdefault((label, d), []).append(i)
            rows, cells, homes, data = [], [], [], []
            for (label, d), at in groups.items():
                x = flat[starts[at][:, None] + np.arange(d)]
                p = shared.value.get((label, d))
                if p is None:
                    visits = np.zeros((len(at), 1), bool)
                    home = np.zeros(len(at), int)
                else:
                    dots = _unit(x) @ p.T  # d^2 = 2 - 2 dot
                    home = dots.argmax(axis=1)
                    homes_here, which = np.unique(home, return_inverse=True)
                    apart = np.sqrt(np.maximum(2 - 2 * p[homes_here] @ p.T, 1e-30))
                    bound = (dots[np.arange(len(at)), home][:, None] - dots) / apart[which]
                    visits = (bound <= tau) & (np.arange(len(p))[None, :] < home[:, None])
                visits[np.arange(len(at)), home] = True
                for r, c in zip(*np.nonzero(visits), strict=True):
                    rows.append(at[r])
                    cells.append(int(c))
                    homes.append(bool(home[r] == c))
                    data.append(x[r].astype(number).tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(dims[rows] if rows else [], pa.int32()), pa.array(cells, pa.int32()), pa.array(homes, pa.bool_()), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(data, pa.binary())], names=["label", "dim", "cell", "home", "rep", "mult", "h1", "x"])

    dealt = classes.select("label", "rep", "mult", "h1", "v").mapInArrow(assign, f"label {label_kind}, dim int, cell int, home boolean, rep {kind}, mult long, h1 long, x binary")
    dealt = stored(dealt)
    # residents of a large cell are split into parts; those of part a visit the parts before it, visitors visit all
    large = dealt.where("home").groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell)
    large = large.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("cell").alias("_c"), F.ceil(F.col("_n") / F.lit(float(cell))).cast("int").alias("_g"))
    dealt = dealt.join(large, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c")), "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    dealt = dealt.withColumn("_own", F.when(F.col("home"), F.pmod(F.xxhash64("h1", F.lit(3)), F.col("_g")).cast("int")).otherwise(F.col("_g") - 1))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumn("home", F.col("home") & (F.col("part") == F.col("_own")))
    dealt = dealt.select("label", "dim", "cell", "part", "home", "rep", "mult", "h1", "x")
    dealt = dealt.repartition("label", "dim", "cell", "part").sortWithinPartitions("label", "dim", "cell", "part", F.col("home").desc())
    return dealt.mapInArrow(_cells(threshold, number), f"rep {kind}, h1 long, n long, other {kind}")


def _cells(threshold: float, number: np.dtype, at_once: int = 1024):
    def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray) -> np.ndarray:
        c = ux @ uy.T
        yes = c >= threshold
        for i, j in zip(*np.nonzero(np.abs(c - threshold) < EDGE), strict=True):
            yes[i, j] = float(x[i] @ y[j]) / (math.sqrt(float(x[i] @ x[i])) * math.sqrt(float(y[j] @ y[j]))) >= threshold
        return yes

    class Cell:
        def __init__(self) -> None:
            self.rows: list[tuple] = []
            self.ready = False

        def build(self) -> Iterator[tuple]:
            """Residents against each other."""
            self.ready = True
            n = len(self.rows)
            if not n:
                return
            self.x = np.array([r[3] for r in self.rows])
            self.u = _unit(self.x)
            self.mult = np.array([r[1] for r in self.rows])
            self.links = np.zeros(n, np.int64)
            self.forest = Forest(n)
            for at in range(0, n, at_once):
                yes = linked(self.x[at : at + at_once], self.x, self.u[at : at + at_once], self.u)
                here = np.arange(at, min(n, at + at_once))
                yes[here - at, here] = False
                self.links[here] += yes @ self.mult
                for i in np.flatnonzero(yes.any(axis=1)).tolist():
                    self.forest.join(at + i, np.flatnonzero(yes[i]))
            yield from ((self.rows[a][0], self.rows[a][2], None, self.rows[b][0]) for a, b in self.forest.links)
            self.forest.links.clear()

        def visit(self, rows: list[tuple]) -> Iterator[tuple]:
            if not self.rows:
                return
            y = np.array([r[3] for r in rows])
            yes = linked(y, self.x, _unit(y), self.u)
            some = np.flatnonzero(yes.any(axis=1))
            if not len(some):
                return
            self.links += np.array([r[1] for r in rows])[some] @ yes[some]
            counts = yes[some] @ self.mult
            for i, n in zip(some.tolist(), counts.tolist(), strict=True):
                yield rows[i][0], rows[i][2], n, None
                near = np.flatnonzero(yes[i])
                roots, first = np.unique(self.forest.root[near], return_index=True)
                for h in near[first].tolist():
                    yield rows[i][0], rows[i][2], None, self.rows[h][0]
                for r in roots[1:]:  # the visitor joins these trees
                    self.forest.root[self.forest.root == r] = roots[0]

        def close(self) -> Iterator[tuple]:
            if self.rows and self.ready:
                yield from ((r[0], r[2], n, None) for r, n in zip(self.rows, self.links.tolist(), strict=True) if n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, now, waiting, kind = None, Cell(), [], None

        def emit() -> pa.RecordBatch:
            a = [pa.array([r[k] for r in out], t) for k, t in enumerate((kind, pa.int64(), pa.int64(), kind))]
            out.clear()
            return pa.RecordBatch.from_arrays(a, names=["rep", "h1", "n", "other"])

        def finish() -> None:
            if not now.ready:
                out.extend(now.build())
            if waiting:
                out.extend(now.visit(waiting))
                waiting.clear()
            out.extend(now.close())

        for b in batches:
            kind = b.column(5).type
            keys = list(zip(*[b.column(c).to_pylist() for c in range(4)], strict=True))
            homes, reps, mults, hashes = (b.column(c).to_pylist() for c in range(4, 8))
            for i in range(b.num_rows):
                if keys[i] != key:
                    if key is not None:
                        finish()
                    key, now = keys[i], Cell()
                row = (reps[i], mults[i], hashes[i], np.frombuffer(b.column(8)[i].as_py(), number).astype(float))
                if homes[i]:
                    now.rows.append(row)
                else:
                    if not now.ready:
                        out.extend(now.build())
                    waiting.append(row)
                    if len(waiting) >= at_once:
                        out.extend(now.visit(waiting))
                        waiting.clear()
                if len(out) >= 10_000:
                    yield emit()
        if key is not None:
            finish()
            yield emit()

    return run
