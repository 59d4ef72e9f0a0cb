"""Line deduplication by a segment-partition edit join.

Lines are normalised (lower case, letters and digits, single blanks); those of
``min_chars`` and more take part. Equal lines are one by their hash. For lines
that differ, each is cut into ``edits + 1`` segments: two lines within
``edits`` of each other share a segment, at a shift that their lengths bound.
Segments are indexed by length, number and hash; a line meets the index and probes the
segments of lines up to ``edits`` shorter at the shifts left of that bound.
A pair that meets goes on if the counts of ten letters, which an edit changes
by two at most, allow it. It is then verified on its texts by a bit-parallel
edit distance in the band of that threshold; lines link when the distance is also at most ``share`` of the longer one.
Classes of lines are the components of the links; the first line of a class by
document and place stays, the others are removed. The normalised lines are
written once to the shared folder, as later passes need them again.

All of it is SQL expressions and joins. Nulls are empty texts. Rows that are
equal in id and text are copies of one document, and only one of them keeps its
lines. Null ids come last. An empty table gives no rows. Other columns are
handed on. Short lines are never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, fresh, let, stored
from evidentia.llm.graph import connected_components


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


#: Letters whose counts tell lines apart before their texts are compared; which ones they are changes only the cost.
LETTERS = "etaoinsrhl"


def letter_counts(norm: Column) -> Column:
    """The counts of ``LETTERS`` modulo 8 in the first 512 characters, three bits each.

    An edit changes the counts by two at most: one character goes and one comes,
    be it in its place or at the end of the 512.
    """

    def counted(start):
        packed = F.lit(0)
        for letter in LETTERS:
            packed = F.shiftleft(packed, 3) + F.pmod(F.octet_length(start) - F.octet_length(F.replace(start, F.lit(letter), F.lit(""))), F.lit(8))
        return packed

    return let(F.left(norm, F.lit(512)), counted)


def letters_apart(a: Column, b: Column) -> Column:
    """At least so much do the counts differ."""
    gaps = [F.pmod(F.shiftright(a, 3 * k) - F.shiftright(b, 3 * k), F.lit(8)) for k in range(len(LETTERS))]
    return sum((F.least(gap, 8 - gap) for gap in gaps[1:]), F.least(gaps[0], 8 - gaps[0]))


def index_moves(edits: int) -> list[tuple[int, int, int]]:
    """Number, length difference and shift of the segments that a line is indexed by."""
    return [(i, 0, 0) for i in range(edits + 1)]


def probe_moves(edits: int) -> list[tuple[int, int, int]]:
    """Number, how much shorter the other line is, and shift, of the segments that a line probes beside those it is indexed by."""
    moves = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            moves += [(i, shorter, shift) for shift in range(low, high + 1) if shorter or shift]
    return moves


def segments(lines: DataFrame, moves: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """``key``, ``line``, ``shorter`` and ``letters``: a row for each of the moves that lies in the line.

    The key is a hash of the segment's number, the other line's length and the
    characters. Where a character is a byte, the segment is cut from the bytes.
    """
    parts = edits + 1
    sized = lines.select("line", "letters", "norm", F.length("norm").alias("size"), (F.octet_length("norm") == F.length("norm")).alias("bytes"))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(shorter).alias("shorter"), F.lit(shift).alias("shift")) for i, shorter, shift in moves])
    moved = sized.withColumn("m", F.explode(listed)).select("line", "letters", "norm", "size", "bytes", "m.*").withColumn("total", F.col("size") - F.col("shorter"))
    longer = parts - F.pmod("total", F.lit(parts))  # the segments from here on have one character more
    base = F.floor(F.col("total") / parts).cast("int")
    placed = moved.withColumn("at", F.col("i") * base + F.greatest(F.lit(0), F.col("i") - longer) + F.col("shift")).withColumn("width", base + (F.col("i") >= longer).cast("int"))
    within = placed.filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("size")))
    slice_ = F.when(F.col("bytes"), F.substring(F.col("norm").cast("binary"), F.col("at") + 1, F.col("width"))).otherwise(F.substring(F.col("norm"), F.col("at") + 1, F.col("width")).cast("binary"))
    return within.select(F.xxhash64("i", "total", slice_).alias("key"), "line", "shorter", "letters")


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two texts if it is ``edits`` at most, else -1, by a bit-parallel band.

    For each number of errors up to ``edits`` a register has a bit for each of the
    ``2 edits + 1`` diagonals of the matrix: whether that diagonal can be reached with
    so many. A character of ``a`` moves all of them at once.
    """
    full = (1 << 2 * edits + 1) - 1

    def ran(left, right):
        def moved(state, same, i):
            out = []
            for e in range(edits + 1):
                reached = state[f"r{e}"].bitwiseAND(same)
                if e:
                    fewer = state[f"r{e - 1}"]
                    reached = reached.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full))
                out.append(reached)
            return F.struct((i + 1).alias("i"), *(r.alias(f"r{e}") for e, r in enumerate(out)))

        def step(state, char):
            i = state["i"]
            same = [F.when(F.get(right, i + d) == char, 1 << d + edits).otherwise(0) for d in range(-edits, edits + 1)]
            dead = state[f"r{edits}"] == 0  # what fewer errors reach, more reach as well
            return F.when(dead, state).otherwise(let(sum(same[1:], same[0]), lambda same: moved(state, same, i)))

        start = F.struct(F.lit(0).alias("i"), *(F.lit((1 << e + 1) - 1 << edits).alias(f"r{e}") for e in range(edits + 1)))
        end = F.size(right) - F.size(left)

        def least(state):
            hit = lambda e: state[f"r{e}"].bitwiseAND(F.element_at(F.array(*(F.lit(1 << d) for d in range(2 * edits + 1))), end + edits + 1)) != 0
            return F.coalesce(*(F.when(hit(e), e) for e in range(edits + 1)), F.lit(-1))

        return F.when(F.abs(end) > edits, -1).otherwise(F.aggregate(left, start, step, least))

    return let(F.split(a, ""), lambda left: let(F.split(b, ""), lambda right: ran(left, right)))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``pos``, ``norm``, ``line`` (the hash of ``norm``) and ``letters`` for the lines that take part."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.transform(F.split(text, "\n"), normalised)).alias("pos", "norm"))
    return lines.filter(F.length("norm") >= min_chars).withColumn("line", F.xxhash64("norm")).withColumn("letters", letter_counts(F.col("norm")))


def similar_lines(lines: DataFrame, *, edits: int, share: float, broadcast_rows: int) -> DataFrame:
    """Links ``a``, ``b`` between different lines; ``lines`` has ``line``, ``norm`` and maybe ``letters``, repeats allowed."""
    if "letters" not in lines.columns:
        lines = lines.withColumn("letters", letter_counts(F.col("norm")))
    # Said here, as only one of the joins below would infer it, and the index would be shuffled for each.
    # One edit needs the longer of two lines to have 1 / share characters, so the shorter may have one less.
    near = lines.filter((F.length("norm") >= int(1 / share) - 1) & F.col("line").isNotNull())
    indexed = segments(near, index_moves(edits), edits).drop("shorter").repartition("key").distinct()
    probing = segments(near, probe_moves(edits), edits).repartition("key").distinct()
    index = indexed.select(F.col("key").alias("a_key"), F.col("line").alias("a"), F.col("letters").alias("a_letters"))
    alike = (F.col("a_key") == F.col("key")) & (letters_apart(F.col("a_letters"), F.col("letters")) <= 2 * edits)
    level = index.join(indexed, alike & (F.col("a") < F.col("line"))).select("a", "line")
    moved = index.join(probing, alike & ((F.col("a") < F.col("line")) | (F.col("shorter") > 0) & (F.col("a") != F.col("line")))).select("a", "line")
    met = level.union(moved)
    pairs = cut_lineage(met.select(F.least("a", "line").alias("a"), F.greatest("a", "line").alias("b")).distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    if pairs.count() <= broadcast_rows:
        involved = F.broadcast(involved)
    texts = near.join(involved, "line", "left_semi").groupBy("line").agg(F.first("norm").alias("norm"))
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("norm").alias("na")), "a").join(texts.select(F.col("line").alias("b"), F.col("norm").alias("nb")), "b")
    distance = edit_distance(F.col("na"), F.col("nb"), edits)
    allowed = F.greatest(F.length("na"), F.length("nb")) * share
    return both.filter(let(distance, lambda d: (d >= 0) & (d <= allowed))).select("a", "b")


def without_copies(lines: DataFrame, distinct: DataFrame, place: Column, shares: int = 32768) -> DataFrame:
    """``lines`` with only the first row of each very frequent line, so that its copies don't meet in one task.

    A line is very frequent with one in ``shares`` of all rows or more; there
    are ``shares`` such lines at most. ``distinct`` has each line's ``n`` and ``first`` place.
    """
    frequent = distinct.filter((F.col("n") > 1) & (F.col("n") >= lines.count() / shares))
    return lines.join(F.broadcast(frequent), "line", "left").filter(F.col("n").isNull() | place.eqNullSafe(F.col("first"))).select(*lines.columns)


def dedup_lines(docs: DataFrame, *, edits: int = 2, share: float = 0.05, min_chars: int = 16, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its repeated lines, and the counts ``n_lines`` and ``n_removed``."""
    lines = stored(_occurrences(docs, min_chars))
    slim = lines.select("doc_id", "text_key", "pos", "line")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "pos")
    distinct = stored(slim.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    roots = connected_components(similar_lines(without_copies(lines, distinct, place), edits=edits, share=share, broadcast_rows=broadcast_rows))
    classed = distinct.join(roots, distinct["line"] == roots["node"], "left").select("line", "first", "n", F.coalesce("root", "line").alias("root"))
    kept = classed.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    repeated = classed.join(kept, "root").select("line", "keep")
    gone = slim.join(repeated, "line").filter(~place.eqNullSafe(F.col("keep")))
    per_doc = gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))

    # One key for the join and the window, so that the texts are dealt out once; a null id has a number of its own kind.
    row, mark, lost, turn = fresh(docs, "row_key", "row_key_g", "gone_", "turn")
    ident = lambda text_key: F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), text_key)
    per_doc = per_doc.select(ident(F.col("text_key")).alias(mark), F.col("gone").alias(lost))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(row, ident(F.xxhash64(text)))
    # Of rows equal in id and text the first keeps its lines, the others lose all that take part.
    keyed = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    joined = keyed.join(per_doc, keyed[row] == per_doc[mark], "left")
    whole = F.split(text, "\n")

    def left_of(all_lines):
        plain = F.filter(all_lines, lambda line, i: ~F.array_contains(F.col(lost), i))
        none = F.filter(all_lines, lambda line: F.length(normalised(line)) < min_chars)
        return F.when(F.col(turn) > 1, none).when(F.col(lost).isNull(), all_lines).otherwise(plain)

    result = let(whole, lambda w: let(left_of(w), lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(w).alias("n"), F.size(k).alias("k"))))
    done = joined.withColumn(lost, result)
    others = [c for c in docs.columns if c != "text"]
    total, removed = fresh(docs, "n_lines", "n_removed")
    return done.select(*others, F.col(lost)["text"].alias("text"), F.col(lost)["n"].cast("long").alias(total), (F.col(lost)["n"] - F.col(lost)["k"]).cast("long").alias(removed))
