"""One-permutation MinHash fingerprints with optimal densification and b-bit storage.

Each five-word shingle is hashed once. The upper bits of a hash name its bin,
and a bin keeps its smallest hash. An empty bin borrows from another, probing
bins in an order that depends on the empty bin alone, so that two texts with
the same non-empty bins borrow alike: a few fixed probes first, then, where
these are all empty, the non-empty bin of smallest pairwise hash. The lowest
``BITS`` bits of each bin are stored, a hex digit for each bin.

Two fingerprints agree in a bin by chance with probability ``2**-BITS``; the
likeness takes that out: ``(share - c) / (1 - c)``, at least 0.

All of it is SQL expressions on one row. Fewer words than a shingle has make
one shingle; a text without words, null included, has the fingerprint of blank
digits, which is like itself alone. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import let

BINS, BITS, SHINGLE = 128, 4, 5
_SHIFT = 64 - BINS.bit_length() + 1
_PROBES = 8


def _probes() -> list[list[int]]:
    """For each bin, the bins it probes first: the upper bits of a multiplicative hash of bin and attempt."""
    mixed = lambda i, k: ((i * 31 + k + 1) * 0x9E3779B97F4A7C15 ^ (i + 1) * 0xC2B2AE3D27D4EB4F) % 2**64
    return [[(mixed(i, k) * 0xFF51AFD7ED558CCD % 2**64) >> _SHIFT for k in range(_PROBES)] for i in range(BINS)]


def shingle_hashes(text: Column) -> Column:
    """A hash of each shingle of the text's words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w):
        few = F.transform(F.filter(F.array(w), lambda x: F.size(x) > 0), lambda x: F.xxhash64(x))
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        many = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) < SHINGLE, few).otherwise(many)

    return let(words, hashes)


def fingerprint(text: Column) -> Column:
    """A string of ``BINS`` hex digits; blanks for a text without words."""
    low = (1 << _SHIFT) - 1
    bin_of = lambda h: F.shiftright(h, _SHIFT)  # noqa: E731  the sign makes it run from -BINS/2
    # The largest hash of each bin stands for "empty": after sorting, the first of each bin is its minimum or this.
    marks = F.transform(F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), _SHIFT).bitwiseOR(F.lit(low)))
    is_mark = lambda h: h.bitwiseAND(F.lit(low)) == low
    probes = F.array(*(F.array(*map(F.lit, row)) for row in _probes()))

    def digits(sorted_):
        dense = F.filter(sorted_, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(sorted_, i - 1))))

        def filled(bins):
            def borrow(i):
                near = F.get(F.filter(F.transform(F.get(probes, i), lambda j: F.get(bins, j)), lambda h: ~is_mark(h)), F.lit(0))
                ranked = F.transform(F.filter(bins, lambda h: ~is_mark(h)), lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("r"), h.alias("h")))
                # Hashed anew for each borrower, so that few shingles don't agree by chance in all bins at once.
                return F.xxhash64(F.coalesce(near, F.array_min(ranked)["h"]), i)

            return F.transform(bins, lambda h, i: F.when(is_mark(h), borrow(i)).otherwise(h))

        return let(dense, filled)

    def drawn(hashes):
        values = let(F.sort_array(F.concat(hashes, marks)), digits)
        hexed = F.array_join(F.transform(values, lambda h: F.lower(F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1))))), "")
        return F.when(F.size(hashes) == 0, F.lit(" " * BINS)).otherwise(hexed)

    return let(shingle_hashes(text), drawn)


def likeness(a: Column, b: Column) -> Column:
    """The estimated resemblance of two fingerprinted texts, 0 to 1."""
    share = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] == p["y"])) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def with_next(docs: DataFrame, *columns: str, rows_per_range: int = 1500, most_ranges: int = 4096) -> DataFrame:
    """``docs`` with ``next``: a struct of ``columns`` of the row after it in descending ``doc_id``, after the last the first.

    Ties of ``doc_id`` go by text; null ids come last. Rows are dealt into
    ranges of ids by approximate quantiles; the first row of each range also
    goes to the range before it, so no range needs another's rows.
    """
    counted = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    n_ranges = max(1, min(most_ranges, counted["ids"] // rows_per_range))
    shares = [k / n_ranges for k in range(1, n_ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()["b"] or [])) if shares else []
    # Ranges are numbered from the largest ids; null ids make the last.
    ascending = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - ascending)
    dealt = docs.withColumn("__range", number)
    firsts = dealt.groupBy("__range").agg(F.max("doc_id").alias("top")).orderBy("__range").collect()  # a row for each range
    before = {r["__range"]: firsts[k - 1]["__range"] for k, r in enumerate(firsts)}
    guest = F.lit(None).cast("int")
    for r in firsts:
        here = (F.col("__range") == r["__range"]) & F.col("doc_id").eqNullSafe(F.lit(r["top"]))
        guest = F.when(here, F.lit(before[r["__range"]])).otherwise(guest)
    if len(firsts) > 64:  # a long chain of conditions would not compile: look it up
        tops = F.array(*(F.struct(F.lit(r["__range"]).alias("r"), F.lit(r["top"]).cast("long").alias("top"), F.lit(before[r["__range"]]).alias("b")) for r in firsts))
        guest = F.get(F.filter(tops, lambda t: (t["r"] == F.col("__range")) & t["top"].eqNullSafe(F.col("doc_id"))), F.lit(0))["b"]
    own = F.array(F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest")))
    places = F.when(guest.isNull(), own).otherwise(F.concat(own, F.array(F.struct(guest.alias("range"), F.lit(True).alias("guest")))))
    spread = dealt.withColumn("__place", F.explode(places)).withColumn("__range", F.col("__place.range")).withColumn("__guest", F.col("__place.guest")).drop("__place")
    order = Window.partitionBy("__range").orderBy("__guest", F.col("doc_id").desc_nulls_last(), "text")
    value = F.struct(*columns)
    return spread.withColumn("next", F.lead(value).over(order)).filter("NOT __guest").drop("__range", "__guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edits, whose second half is taken from the next document."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(base, "text", "fingerprint")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    full = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next"))
    both = full.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
