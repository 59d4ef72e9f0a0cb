"""Personal data by patterns, and by what the corpus says about words beside it.

Emails, addresses, card and phone numbers, and secrets (a named value with a
digit, or a key of a known form) are found by patterns; these are the protected
entities. The corpus then says how strongly a word in an entity's
documents gives it away. With n(e), n(t) and n(t, e) the texts that hold the
entity, the term, and both, of N in all, the information that t gives on e is
``log2(N n(t, e) / (n(t) n(e)))``, and what there is to know of e is
``log2(N / n(e))``. A term is disclosing when the ratio of the two exceeds
``generalise``; over ``remove`` it is removed. That a rare word stands beside an
entity once is no evidence: both must stand in ``least_texts`` different texts and
meet in as many. Of all pairs that could (those of such entities and terms that
meet at all) a pair counts only when so many meetings would be rarer than
``chance`` divided by the number of these pairs if e and t were independent, by
Chernoff's bound. So at most a share ``chance`` of corpora without any
association gets a term marked. Copies of one text say a thing once; texts that
differ in a character are different.

Documents that hold the entity have all occurrences of its disclosing terms
covered by spans of the kind ``term``, except where a pattern's span lies. A
secret's span takes in its name, and yields to the other patterns.
Offsets are code points, ends exclusive. Nulls are empty texts without spans.
Repeated rows get equal results and count as documents of their own. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, let, stored

KINDS = ("email", "ip", "card", "phone")

#: Possessive forms that match what their plain forms do, at a cost linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Names of secrets with a value of eight characters and more, one a digit, and keys of known forms.
SECRET = (
    r"(?i:\b(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?=[^\s\"'<>]*[0-9])[^\s\"'<>]{8,}+)"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}+)"
)

#: A cheap sign without which a pattern can't match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_SPAN = "struct<kind:int,start:int,end:int,hit:string>"
_MARKS = ".,;:!?()[]{}\"'`*_#<>|&%$/\\"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: _small(p))
    if kind == "card":
        return let(_digits(hit), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _small(part: Column) -> Column:
    """Whether a run of digits is 255 at most."""
    return let(F.regexp_replace(part, "^0+(?=[0-9])", ""), lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(p.cast("int") <= 255))


def _spans(text: Column, kind: str) -> Column:
    """Valid matches, leftmost and non-overlapping: pieces between matches and the matches, laid end to end."""
    pattern, number = (PATTERNS[kind], KINDS.index(kind)) if kind in KINDS else (SECRET, len(KINDS))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    none = F.array().cast(f"array<{_SPAN}>")

    def add(acc, x):
        start = acc["at"] + x["piece"]
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = let(hits, lambda h: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(h)).alias("piece"), h.alias("hit")))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    sign = SIGNS.get(kind)
    possible = F.contains(text, F.lit(sign)) if sign else F.lit(True) if kind in KINDS else F.rlike(text, F.lit(pattern))
    return F.when(possible, found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Pattern matches by kind, then start."""
    return F.concat(*(_spans(text, kind) for kind in KINDS))


def secret_spans(text: Column, found: Column) -> Column:
    """Secrets that no span of ``found`` overlaps."""
    return F.filter(_spans(text, "secret"), lambda s: ~F.exists(found, lambda f: (f["start"] < s["end"]) & (f["end"] > s["start"])))


def term_of(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(_MARKS)))


def _tokens(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]", -1)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(_tokens(text), term_of)), lambda t: (F.length(t) >= 3) & ~F.contains(t, F.lit("@")))


def disclosing_terms(slim: DataFrame, holding: DataFrame, *, generalise: float, remove: float, chance: float, least_texts: int, broadcast_rows: int) -> DataFrame:
    """``text_key`` and ``terms``, a map from term to whether it is removed, for texts with disclosing terms.

    ``slim``: all rows' ``text_key`` and ``text``; ``holding``: those with entities, and their spans ``hits``.
    """
    held = holding.dropDuplicates(["text_key"])
    entities = F.array_distinct(F.transform("hits", lambda f: F.lower(f["hit"])))
    held = stored(held.select("text_key", entities.alias("entities"), _terms(F.col("text")).alias("terms")))
    holds = held.select("text_key", F.explode("entities").alias("entity"))
    copies = cut_lineage(slim.groupBy("text_key").agg(F.count("*").alias("copies")))
    n = float(max(2, copies.count()))
    n_e = holds.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= least_texts)
    # At this count or less can a term say enough of an entity that n_e texts hold.
    most = F.pow(F.lit(n), F.lit(1 - generalise)) * F.pow(F.col("n_e"), F.lit(generalise)) * (1 + 1e-9)
    top = n_e.agg(F.max(most)).first()[0]
    if top is None:
        return held.select("text_key", F.create_map().cast("map<string,boolean>").alias("terms")).limit(0)
    # Counted over all terms before the join: a common term is one row there, not one for each document.
    # Each of so many copies counts for its share, so the texts need not be dealt out to leave one of each.
    several = copies.filter("copies > 1")
    if several.count() <= broadcast_rows:
        several = F.broadcast(several)
    own = slim.select("text_key", "text").join(several, "text_key", "left").select(_terms(F.col("text")).alias("terms"), (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    n_t = own.select(F.explode("terms").alias("term"), "share").groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t")).filter(F.col("n_t").between(least_texts, top))
    rare = held.select("text_key", F.explode("terms").alias("term")).join(n_t, "term")
    sized = holds.join(n_e.withColumn("most", most), "entity")
    met = stored(sized.join(rare, "text_key").filter(F.col("n_t") <= F.col("most")))
    both = stored(met.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")))
    tested = float(max(1, both.count()))
    known = F.log2(n / F.col("n_e"))
    given = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    ratio = F.when(known > 0, given / known).otherwise(F.lit(0.0))
    expected = F.col("n_e") * F.col("n_t") / F.lit(n)
    likely = F.col("n_te") * (F.log(expected / F.col("n_te")) + 1) - expected  # the log of the bound where more met than expected
    strong = both.withColumn("ratio", ratio).filter((F.col("ratio") >= generalise) & (F.col("n_te") >= least_texts) & (F.col("n_te") > expected) & (likely <= F.log(F.lit(chance / tested))))
    per_text = met.select("text_key", "entity", "term").join(strong.select("entity", "term", "ratio"), ["entity", "term"])
    best = per_text.groupBy("text_key", "term").agg(F.max("ratio").alias("ratio"))
    return best.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("ratio") >= remove))).alias("terms"))


def _term_spans(text: Column, terms: Column, found: Column) -> Column:
    """Occurrences of the terms as spans of kind 5, whose ``hit`` is what takes their place."""

    def of_tokens(tokens):
        """One pass with the place so far; a span is made only where a term stands."""

        def step(acc, token):
            bare = F.btrim(token, F.lit(_MARKS))
            start = acc["at"] + F.length(token) - F.length(F.ltrim(token, F.lit(_MARKS)))
            put = F.when(terms[term_of(token)], F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(bare, r"\p{L}", "x"), r"\p{N}", "0"))
            span = F.struct(F.lit(len(KINDS) + 1).alias("kind"), start.alias("start"), (start + F.length(bare)).alias("end"), put.alias("hit"))
            free = ~F.exists(found, lambda f: (f["start"] < start + F.length(bare)) & (f["end"] > start))
            out = F.when(F.map_contains_key(terms, term_of(token)) & free, F.concat(acc["out"], F.array(span).cast(f"array<{_SPAN}>"))).otherwise(acc["out"])
            return F.struct((acc["at"] + F.length(token) + 1).alias("at"), out.alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(tokens, zero, step, lambda acc: acc["out"])

    return F.when(terms.isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(let(_tokens(text), of_tokens))


def find_personal_data(docs: DataFrame, *, generalise: float = 0.8, remove: float = 0.9, chance: float = 0.01, least_texts: int = 2, broadcast_rows: int = 5_000, broadcast_copies: int = 200_000) -> DataFrame:
    """``doc_id``, ``text``, ``found`` (base spans), ``secrets`` and ``terms`` (spans of disclosing terms), a row per document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    found = slim.withColumn("found", base_spans(F.col("text"))).withColumn("secrets", secret_spans(F.col("text"), F.col("found")))
    some = F.size(F.concat("found", "secrets")) > 0
    # Few documents hold an entity; only these are stored and joined, the others keep where they are.
    holding = stored(found.filter(some))
    hits = holding.select("text_key", "text", F.concat("found", "secrets").alias("hits"))
    strong = cut_lineage(disclosing_terms(slim, hits, generalise=generalise, remove=remove, chance=chance, least_texts=least_texts, broadcast_rows=broadcast_copies))
    strong = strong.select(F.col("text_key").alias("s_key"), F.col("terms").alias("s_terms"))
    if strong.count() <= broadcast_rows:
        strong = F.broadcast(strong)
    joined = holding.join(strong, F.col("text_key") == F.col("s_key"), "left")
    with_entities = joined.select("doc_id", "text", "found", "secrets", _term_spans(F.col("text"), F.col("s_terms"), F.concat("found", "secrets")).alias("terms"))
    none = F.array().cast(f"array<{_SPAN}>")
    return with_entities.unionByName(found.filter(~some).select("doc_id", "text", none.alias("found"), none.alias("secrets"), none.alias("terms")))


def sanitised(text: Column, found: Column, terms: Column) -> Column:
    """The text with pattern spans as ``<KIND>`` and terms generalised or removed; of overlapping pattern spans the first counts."""
    labels = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, "secret")))
    shown = F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.get(labels, f["kind"]).alias("put")))
    hidden = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("put")))
    ordered = F.array_sort(F.concat(shown, hidden))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), kept.alias("out")))

    return F.aggregate(ordered, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def digest(personal: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the pattern spans, and all spans as text."""
    names = F.array(*map(F.lit, (*KINDS, "secret", "term")))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("found", lambda f: f["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    counts.append(F.size("secrets").cast("long").alias("n_secret"))
    return personal.select("doc_id", *counts, F.sha2(spelled(F.col("found")).cast("binary"), 256).alias("base_sha256"), spelled(F.concat("found", "secrets", "terms")).alias("spans"))
