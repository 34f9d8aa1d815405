"""Line deduplication by a segment-partition edit join (operator 9). DataFrame functions alone."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import few, renamed, set_aside, stored
from presslens.operators.components import connected_components

#: Level by level: segments a line is cut into beyond the threshold, and how many pairs of lines may be compared by sketches under a signature; if there are more, signatures of the next level take its place.
#: A comparison takes about as many nanoseconds as a row of finer signatures, of which a line has hundreds, takes microseconds.
LEVELS = ((1, 1 << 18), (6, 1 << 18), (14, 1 << 18))
#: With how many lines of a signature that stays hot the others are tried, round by round, before those still apart are tried with each other.
LEADERS = (4, 64)
#: Pairs that a task verifies.
PAIRS = 1000
#: Up to so many numbers of lines to remove are broadcast; beyond it the texts are joined by a shuffle.
REMOVED = 4_000_000
#: Lines that occur more often than this, and than one in COMMON_SHARE of all, are entered once. The others' repeats cost less than looking for them.
COMMON, COMMON_SHARE = 64, 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal_line(line: Column) -> Column:
    """What is compared: white space as one space and none at the ends. Case counts."""
    odd = None
    for c in ("\t", "\x0b", "\x0c", "\r", "  "):  # few lines are: rewriting all of them costs more than the search
        odd = line.contains(c) if odd is None else odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def patterns(parts: int, threshold: int) -> list[tuple[int, int, list[tuple[int, int, int]], list[tuple[int, int, int, int]]]]:
    """(less, hole, pieces, gaps): the ways to read a line of ``parts`` segments with ``threshold`` of them left out.

    Edits are at most threshold, so some choice of that many segments (hole numbers the choices) covers all edits between a line and its partner, and the text between the
    segments left out is the same in both. A piece (from, to, move) is the segments from..to - 1 of a partner that is shorter by less, read ``move`` characters to the right. Across left-out segments that lie
    side by side the move changes by at most their number; past the last ones it is less. With no move at all a line reads itself.
    A gap (from, to, move before, move after) is a run of left-out segments. Where there are several, each holds an edit: if one held none, a choice with fewer gaps would cover all edits.
    """
    out = []
    for hole, gone in enumerate(combinations(range(parts), threshold)):
        runs: list[list[int]] = []
        for i in gone:
            if runs and runs[-1][1] == i:
                runs[-1][1] += 1
            else:
                runs.append([i, i + 1])
        edges = [0, *(e for r in runs for e in r), parts]
        texts = list(zip(edges[::2], edges[1::2], strict=True))  # before, between and after the runs; maybe empty at the ends
        found = {}
        for step in product(*[range(-(b - a), b - a + 1) for a, b in runs]):
            if 0 <= sum(step) <= threshold:
                moves = [sum(step[:k]) for k in range(len(step) + 1)]
                pieces = [(a, b, m) for (a, b), m in zip(texts, moves, strict=True) if a < b]
                gaps = [(a, b, moves[i], moves[i + 1]) for i, (a, b) in enumerate(runs)] if len(runs) > 1 else []
                found[sum(step), tuple(pieces)] = gaps
        out += [(less, hole, list(pieces), gaps) for (less, pieces), gaps in sorted(found.items())]
    return out


def signatures(lines: DataFrame, parts: int, threshold: int, least: int) -> DataFrame:
    """(token, k1, entry) for the lines (k1, line) of at least ``least`` characters: two lines within the threshold share a token that is an entry (entry = 1: the line read as it is) of the shorter one.

    With more segments than threshold + 1, gap0, gap1, ... are added: the hashes of the gaps if there are several, null if not. Lines that share a token matter only if all these differ.
    """
    ways = patterns(parts, threshold)
    most, width = (max(len(w[k]) for w in ways) for k in (2, 3))
    fields = ["less", "hole", "entry", *(f"{c}{i}" for i in range(most) for c in "abm"), *(f"{c}{i}" for i in range(width) for c in "fgxy")]
    pad = lambda found, n, empty: [v for x in [*found, *[empty] * (n - len(found))] for v in x]
    rows = [(less, hole, int(less == 0 and not any(m for _, _, m in p)), *pad(p, most, (0, 0, 0)), *pad(g, width, (0, 0, 0, 0))) for less, hole, p, g in ways]
    spec = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, r, strict=True)]) for r in rows])
    x, size = F.col("x"), F.col("size")
    base, shorter = F.floor(size / F.lit(parts)).cast("int"), F.lit(parts) - F.pmod(size, F.lit(parts))
    edge = lambda i: i * base + F.greatest(i - shorter, F.lit(0))  # noqa: E731  even segments, the longer ones last
    read = lambda start, end: F.substring(F.col("line"), start + 1, end - start)
    pieces = [read(edge(x[f"a{i}"]) + x[f"m{i}"], edge(x[f"b{i}"]) + x[f"m{i}"]) for i in range(most)]
    gaps = [F.when(x[f"f{i}"] < x[f"g{i}"], F.xxhash64(read(edge(x[f"f{i}"]) + x[f"x{i}"], edge(x[f"g{i}"]) + x[f"y{i}"]))).alias(f"gap{i}") for i in range(width)]
    long = lines.select("k1", "line", F.length("line").alias("n")).where(F.col("n") >= least)
    ways = long.select("k1", "line", "n", F.explode(spec).alias("x")).withColumn("size", F.col("n") - x["less"]).where(size >= least)
    return ways.select(F.xxhash64(size, x["hole"], *pieces).alias("token"), "k1", x["entry"].alias("entry"), *(gaps if parts > threshold + 1 else []))


def shared(rows: DataFrame) -> DataFrame:
    """The rows of signatures(), each once, of tokens that are an entry of one line and belong to another too."""
    dealt = rows.repartition("token")
    tokens = dealt.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("entry").alias("e")).where("lo < hi AND e = 1").select("token")
    return stored(dealt.join(tokens.hint("shuffle_hash"), "token").distinct())


def sketches(line: Column) -> tuple[Column, Column]:
    """64 parities each: of how often letters occur, and pairs of neighbouring letters. An edit changes at most 2 of the first and 4 of the second."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    parity = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))
    letters = F.split(line, "")
    return parity(F.transform(letters, lambda c: F.hash(c))), let(letters, lambda cs: parity(F.transform(cs, lambda c, i: F.hash(c, F.get(cs, i + 1)))))


def met(rows: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the lines of rows and of others that share a token, as an entry of that in rows, differ in all gaps, have sketches that allow the threshold, and different roots if there are roots."""
    right = others.select(*[F.col(c).alias(f"{c}_") for c in others.columns])
    matter = (F.col("k1") != F.col("k1_")) & (F.col("entry") == 1)
    if rows is others:  # two entries meet once
        matter = matter & ((F.col("entry_") == 0) | (F.col("k1") < F.col("k1_")))
    for c, most in (("letters", 2 * threshold), ("pairs_of_letters", 4 * threshold)):
        matter = matter & (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) <= most)
    for c in rows.columns:
        if c.startswith("gap"):
            matter = matter & F.coalesce(F.col(c) != F.col(f"{c}_"), F.lit(True))
    if "root" in rows.columns:
        matter = matter & (F.col("root") != F.col("root_"))
    return rows.join(right, (F.col("token") == F.col("token_")) & matter).select(F.least("k1", "k1_").alias("a"), F.greatest("k1", "k1_").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the nodes (structs of both hashes) of the pairs (a, b) of k1 whose edit distance is at most threshold. texts is (k1, k2, line)."""
    left, right = (texts.select(F.col("k1").alias(k), F.struct("k1", "k2").alias(f"node_{k}"), F.col("line").alias(f"line_{k}"), F.length("line").alias(f"n_{k}")) for k in "ab")
    beside = pairs.join(left, "a").join(right, "b").where(F.abs(F.col("n_a") - F.col("n_b")) <= threshold)
    swap = F.col("n_a") > F.col("n_b")
    ordered = beside.select("node_a", "node_b", F.when(swap, F.col("line_b")).otherwise(F.col("line_a")).alias("short"), F.when(swap, F.col("line_a")).otherwise(F.col("line_b")).alias("long"))
    ordered = ordered.repartition(pairs.count() // PAIRS + 1)  # the rows are small but take long: by their bytes they would all come to one task
    # a draw below 1 doesn't change which whole numbers are small enough, but keeps the optimizer from verifying ahead of the repartition
    near = let(differing(F.col("short"), F.col("long")), lambda x: banded_distance(x["a"], x["b"], threshold))
    return ordered.where(near + F.rand(0) < threshold + 1).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def edit_links(lines: DataFrame, threshold: int = 2, least: int = 16) -> DataFrame:
    """(a, b): links between different lines (k1, k2, line; of at least ``least`` characters, repeats allowed) whose edit distance is at most threshold, so many that they join all lines which such pairs join.

    Lines meet under signatures of threshold + 1 segments; those whose sketches are too far apart are discarded, the others verified. Where too many pairs would meet (LEVELS) under one, as in a large group of near copies of one line, its lines meet under signatures of more segments instead, whose larger part is
    equal: lines that differ in other places than their edits allow no longer do. Under those that stay hot, lines are tried with a few of them first; only lines that are still in different components are then tried with each other.
    """
    found = shared(signatures(lines, threshold + LEVELS[0][0], threshold, least))
    texts = lines.join(few(found.select(F.col("k1").alias("_k")).distinct()), F.col("k1") == F.col("_k"), "left_semi").select("k1", "k2", "line").distinct()
    texts = stored(texts.repartition("k1").withColumns(dict(zip(("letters", "pairs_of_letters"), sketches(F.col("line")), strict=True))))
    told = few(texts.select("k1", "letters", "pairs_of_letters").distinct())
    pairs, hot = None, None
    for level, (more, most) in enumerate(LEVELS):
        if level:
            named = hot.select(F.col("k1").alias("_k")).distinct()
            found = shared(signatures(texts.join(named, F.col("k1") == F.col("_k"), "left_semi"), threshold + more, threshold, least))
        found = found.join(told, "k1")
        tokens = found.groupBy("token").agg((F.sum("entry") * (F.count(F.lit(1)) - 1)).alias("pairs"))
        many = stored(tokens.where(F.col("pairs") > most).select("token"))
        cold, hot = (found.join(few(many), "token", how) for how in ("left_anti", "left_semi"))
        meet = met(cold, cold, threshold)
        pairs = meet if pairs is None else pairs.unionByName(meet).distinct()
        if many.isEmpty():
            return verified(stored(pairs), texts, threshold)
    tried = stored(pairs)
    links, hot = stored(verified(tried, texts, threshold)), stored(hot)
    for r, most in enumerate((*LEADERS, None)):
        roots = connected_components(links).select(F.col("node.k1").alias("k1"), "root")
        rooted = hot.join(roots, "k1", "left").withColumn("root", F.coalesce(F.col("root.k1"), F.col("k1")))
        apart = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
        hot = stored(rooted.join(apart, "token", "left_semi"))
        if hot.isEmpty():
            break
        lead = hot
        if most:
            order = Window.partitionBy("token").orderBy(F.xxhash64("k1", F.lit(r)), "k1")  # one order for all tokens, so that groups that overlap have the same leaders
            lead = hot.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).drop("at")
        meet = met(hot, hot, threshold) if lead is hot else met(hot, lead, threshold).unionByName(met(lead, hot, threshold)).distinct()
        now = stored(meet.join(tried, ["a", "b"], "left_anti"))
        links = stored(links.unionByName(verified(now, texts, threshold)))
        tried, hot = tried.unionByName(now), hot.drop("root")
    return links


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def differing(a: Column, b: Column) -> Column:
    """The struct (a, b) without the characters that both start with and then both end with; the edit distance stays. Found by powers of two, so runs of more than 2^21 characters are taken off in part."""
    powers = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    least = F.least(F.length(a), F.length(b))

    def start(n: Column, p: Column) -> Column:
        return n + F.when((n + p <= least) & (F.substring(a, n + 1, p) == F.substring(b, n + 1, p)), p).otherwise(0)

    def end(n: Column, p: Column, before: Column) -> Column:
        same = F.substring(a, F.length(a) - n - p + 1, p) == F.substring(b, F.length(b) - n - p + 1, p)
        return n + F.when((before + n + p <= least) & same, p).otherwise(0)

    def rest(before: Column) -> Column:
        after = F.aggregate(powers, F.lit(0), lambda n, p: end(n, p, before))
        return let(after, lambda n: F.struct(F.substring(a, before + 1, F.length(a) - before - n).alias("a"), F.substring(b, before + 1, F.length(b) - before - n).alias("b")))

    return let(F.aggregate(powers, F.lit(0), start), rest)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of a and b if it is at most threshold, else a larger number. b is at least as long as a, by at most threshold.

    Bit-parallel over the band of 2 threshold + 1 diagonals (Hyyro, 2003): for each character of b one step on bit vectors of vertical differences, which moves
    the band down by one row of a; the score follows the lowest diagonal of the band and then climbs to the end of a.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    number = lambda x: F.lit(x).cast("long")

    def step(s: Column, j: Column, x: Column) -> Column:
        # bit k stands for row j - threshold + k of a, counted from 1
        return let(F.element_at(x["columns"], j), lambda c: moved(s, j, x, c))

    def moved(s: Column, j: Column, x: Column, c: Column) -> Column:
        rows, n = x["rows"], x["n"]
        match = number(0)
        for k in range(width):
            row = j + (k - threshold)
            match = match + F.when((row >= 1) & (row <= n), F.when(F.get(rows, row - 1) == c, number(1 << k)).otherwise(number(0))).otherwise(number(0))
        vp, vn = s["vp"], s["vn"]
        d0 = let(match, lambda x: (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(number(full)))
        both = let(d0, lambda d: F.struct(d.alias("d0"), vn.bitwiseOR(number(full) - d.bitwiseOR(vp)).alias("hp"), d.bitwiseAND(vp).alias("hn"), F.shiftright(d, 1).alias("down")))
        return let(both, lambda y: after(s, j, n, y["d0"], y["hp"], y["hn"], y["down"]))

    def after(s: Column, j: Column, n: Column, d0: Column, hp: Column, hn: Column, down: Column) -> Column:
        # the lowest diagonal while it is inside a; below the last row of a the score moves along that row
        at = F.call_function("shiftleft", number(1), (n - j + threshold).cast("int"))
        along = F.when(hp.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0)
        change = F.when(j + threshold <= n, F.when(d0.bitwiseAND(number(top)) != 0, 0).otherwise(1)).otherwise(along)
        return F.struct((hn.bitwiseOR(number(full) - down.bitwiseOR(hp))).alias("vp"), hp.bitwiseAND(down).alias("vn"), (s["score"] + change).cast("int").alias("score"))

    # before the first character the band holds rows 1 - threshold .. threshold of column 0: differences of 1 below row 0
    def walk(x: Column) -> Column:
        first = F.struct(number(full - ((1 << threshold) - 1)).alias("vp"), number(0).alias("vn"), F.least(F.lit(threshold), x["n"]).alias("score"))
        return F.when(x["m"] == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), x["m"]), first, lambda s, j: step(s, j, x), lambda s: s["score"]))

    return let(F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), F.length(a).alias("n"), F.length(b).alias("m")), walk)


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, at, line, k1, k2) for the lines of at least ``least`` characters of docs (doc_id, row, text): at is the line's number from 0, line is normal, k1 and k2 are two hashes of it."""
    rows = docs.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    rows = rows.withColumn("line", normal_line(F.col("line"))).where(F.length("line") >= least)
    return rows.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit("second"), F.col("line")))


def dedup_lines(docs: DataFrame, threshold: int = 2, least: int = 16, id_col: str = "doc_id", text_col: str = "text", equal: int | None = None) -> DataFrame:
    """docs with n_lines, removed (numbers of the removed lines, from 0, in order) and, in place of the text, the text without them.

    Runs of white space count as one space. Two lines link if they are equal or their edit distance is at most threshold; of all lines reachable by links only the first stays, by doc_id (null first) and line number.
    Lines of fewer than ``least`` characters link by equality alone if they have ``equal`` characters or more, else (or if equal is None) they always stay. A line that a third of the documents hold is entered into the join
    once, and its first place is a grouped minimum. Null texts stay null, with no lines; empty ones have one, empty.
    Rows that repeat a document are the same document and keep the same lines. Columns of docs with the new names are replaced; any other name may be used.
    """
    rows, own = set_aside(docs, "n_lines", "removed")
    rows = rows.withColumn("doc_id", F.col(renamed(docs, id_col))).withColumn("text", F.col(renamed(docs, text_col)).cast("string")).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = stored(occurrences(rows.select("doc_id", "row", "text"), least if equal is None else min(least, equal)))
    repeated = stored(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("doc_id", "row", "at")).alias("pick")).where("n > 1"))
    common = repeated.where(F.col("n") > max(COMMON, lines.count() // COMMON_SHARE)).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "pick")
    once = lines.join(few(common), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").where(F.col("pick").isNull() | (F.col("pick") == F.xxhash64("doc_id", "row", "at")))
    roots = connected_components(edit_links(once.select("k1", "k2", "line"), threshold, least))
    node = F.struct("k1", "k2")
    classes = stored(repeated.select(node.alias("node")).join(roots, "node", "full").select("node.k1", "node.k2", F.coalesce("root", "node").alias("root")))
    places = lines.select("doc_id", "row", "at", "k1", "k2").join(few(classes), ["k1", "k2"]).select("doc_id", "row", "at", "root")
    stays = stored(places.groupBy("root").agg(F.min(F.struct("doc_id", "row", "at")).alias("stays")))
    gone = places.join(few(stays), "root").where(~F.struct("doc_id", "row", "at").eqNullSafe(F.col("stays")))
    # rows that repeat a document give the same places: each once
    gone = stored(gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_set("at")).alias("removed")))
    if (gone.agg(F.sum(F.size("removed") + 4)).first()[0] or 0) <= REMOVED:
        gone = F.broadcast(gone)
    found = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    removed, text = F.coalesce("removed", F.array().cast("array<int>")), F.col("text")
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), removed), lambda i: F.get(x, i))
    kept = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(let(lines_of(text), stay), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("long")
    return found.select(*[kept.alias(name) if c == renamed(docs, text_col) else F.col(c).alias(name) for name, c in own.items()], n.alias("n_lines"), removed.alias("removed"))
