"""Mixing sources to target weights by systematic sampling (operator 4). DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import WORD, few, given_back, renamed, set_aside, stored

#: Decimals of the targets, so that sums in another order give the same draws.
DECIMALS = 6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: float) -> DataFrame:
    """sizes (source, source_size) with target, the words that the mix is to take of each source.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes. No target exceeds ceiling times its source's size; the excess is shared anew by weight until none does.
    That is a level of words per unit of weight, with the sources of the least ceiling / weight at their ceiling: found with running sums over one row a source.
    """
    by_name, by_bound = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("bound", F.col("source").asc_nulls_last())
    before, whole = by_bound.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    n = len(weights)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    t = sizes.withColumn("weight", turn).withColumn("most", F.lit(float(ceiling)) * F.col("source_size")).withColumn("bound", F.col("most") / F.col("weight"))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source, by bound, that stays below its ceiling sets the level of all after it
    t = t.withColumn("turn", F.row_number().over(by_bound))
    level = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("turn", "level"))).over(whole)["level"]
    return t.withColumn("level", level).withColumn("target", F.round(F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))), DECIMALS)).select("source", "source_size", "target")


def _digest(*parts: Column) -> Column:
    """A number of 60 bits that other engines can make too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def place(size: Column, number: Column) -> Column:
    """Where a document stands in its source's order: one half at random in rising size classes (eighths of an octave), the other in falling ones.

    A draw along sizes that rise or fall takes too much or too little by up to half the largest document, as the offset falls; over a rise and a fall that cancels.
    """
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 8).cast("int")
    return F.when(F.pmod(number, F.lit(2)) == 0, octave - 1000).otherwise(1000 - octave)


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, seed: str = "0", cell: int = 2000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document.

    Every document of a source has the same expected copies, target / source_size. Along the source's documents, ordered as place() says and then at random, their prefix sum plus one random
    offset of the source crosses a whole number as often as the document is taken: copies are the expected number rounded up or down, never above the ceiling, and the words taken miss the target by about a document.
    Prefix sums need a document's rank within its source. No task gets a source whole: the documents of a place are dealt to cells of about ``cell`` of them, counted, and ranked inside their cell.
    Null texts have size 0; null sources are one source; rows without an id, or that share one, are told apart by their texts; rows that repeat are drawn each. A source without words has target 0. An empty table gives an empty one.
    Columns of docs with the new names are replaced; any other name may be used.
    """
    rows, own = set_aside(docs, "size", "source_size", "target", "copies")
    return _drawn(docs, rows, weights, ceiling, seed, cell, id_col, text_col, source_col).select(*given_back(own), "size", "source_size", "target", "copies")


def _drawn(docs: DataFrame, rows: DataFrame, weights: tuple[int, ...], ceiling: float, seed: str, cell: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """rows, docs as set_aside() renames it, with the new columns of draw()."""
    text = F.col(renamed(docs, text_col))
    d = rows.withColumn("size", words(text)).withColumn("hash", _digest(F.lit(seed), F.coalesce(F.col(renamed(docs, id_col)).cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    d = d.withColumn("class", place(F.col("size"), F.col("hash"))).withColumn("src", F.col(renamed(docs, source_col)).cast("string"))
    narrow = stored(d.select(F.col("src").alias("source"), F.col("class").alias("of"), "hash", "size"))  # the texts are read once for the counts, once for the rows
    by_class = stored(narrow.groupBy("source", "of").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    wanted = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ceiling).withColumnRenamed("source", "t")
    earlier = Window.partitionBy("source").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    classes = by_class.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("cells", F.ceil(F.col("n") / F.lit(float(cell))).cast("long"))
    classes = classes.join(wanted, F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), F.col("of").alias("sc"), "before", "cells", "source_size", "target")
    classes = few(stored(classes))  # a row for each source and class of size
    # the class takes the lowest bit of the hash, the cell the others
    in_cell = F.pmod(F.shiftright("hash", 1), F.col("cells"))
    earlier = Window.partitionBy("ks", "kc").orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)
    cells = narrow.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("of") == F.col("sc"))).groupBy(F.col("s").alias("ks"), F.col("sc").alias("kc"), in_cell.alias("kb")).agg(F.count(F.lit(1)).alias("m"))
    cells = few(stored(cells.withColumn("skip", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")))
    dealt = d.join(classes, F.col("src").eqNullSafe(F.col("s")) & (F.col("class") == F.col("sc"))).withColumn("cell", in_cell)
    placed = dealt.join(cells, F.col("s").eqNullSafe(F.col("ks")) & (F.col("class") == F.col("kc")) & (F.col("cell") == F.col("kb")))
    inside = Window.partitionBy("s", "class", "cell").orderBy("hash", F.col(renamed(docs, id_col)).asc_nulls_first())
    rank = (F.col("before") + F.col("skip") + F.row_number().over(inside)).cast("double")
    offset = _digest(F.lit(seed), F.lit("offset"), F.coalesce(F.concat(F.lit("s"), F.col("s")), F.lit("null"))).cast("double") / F.lit(float(16**15))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("rank", rank).withColumn("rate", rate).withColumn("offset", offset)
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return placed.withColumn("copies", crossed.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, seed: str = "0", cell: int = 2000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as draw() says, with the columns of docs, all as they are. Nulls, ties, repeated rows and empty tables are as in draw(); texts without words are taken as often as others of their source."""
    rows, own = set_aside(docs)
    taken = _drawn(docs, rows, weights, ceiling, seed, cell, id_col, text_col, source_col).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*given_back(own))


def draw_sql(weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, seed: str = "0", cell: int = 2000, docs: str = "documents") -> str:
    """doc_id, size, source_size, target, taken in DuckDB's SQL."""
    turns = ", ".join(f"CAST({w} AS DOUBLE)" for w in weights)
    digest = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    return f"""
        WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {docs}),
        g AS (SELECT *, {digest(f"concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))")} AS h, CAST(floor(log2(CAST(greatest(size, 1) AS DOUBLE)) * 8) AS INTEGER) AS octave FROM d),
        e AS (SELECT *, CASE WHEN h % 2 = 0 THEN octave - 1000 ELSE 1000 - octave END AS class FROM g),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [{turns}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INTEGER) + 1] AS weight, {float(ceiling)!r} * source_size AS most FROM s),
        l AS (SELECT *, most / weight AS bound, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT first(level ORDER BY bound, source NULLS LAST) AS level FROM l WHERE level <= bound),
        t AS (SELECT source, source_size, round(least(most, coalesce((SELECT level FROM f) * weight, most)), {DECIMALS}) AS target FROM l),
        c AS (SELECT source, class, CAST(ceil(count(*) / {float(cell)!r}) AS BIGINT) AS cells FROM e GROUP BY source, class),
        r AS (SELECT e.doc_id, e.size, t.source_size, t.target, e.source,
                     CAST(row_number() OVER (PARTITION BY e.source ORDER BY e.class, (h >> 1) % cells, h, e.doc_id NULLS FIRST) AS DOUBLE) AS pos,
                     CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
                     CAST({digest(f"concat_ws('|', '{seed}', 'offset', coalesce('s' || e.source, 'null'))")} AS DOUBLE) / {float(16**15)!r} AS u
              FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source JOIN c ON e.source IS NOT DISTINCT FROM c.source AND e.class = c.class)
        SELECT doc_id, size, source_size, target, CAST((floor(pos * rate + u) - floor((pos - 1) * rate + u)) * size AS BIGINT) AS taken FROM r"""
