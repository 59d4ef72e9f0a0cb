"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without content of their own.
STOPWORDS = """
a an the and or but if then than that this these those of in on at to for from by with
without into over under between among during before after above below is are was were be
been being has have had do does did not no nor so such as it its their there here which
who whom whose what when where why how all any both each few more most other some only own
same too very can will just should now we our us they them he she his her you your i
""".split()

#: Words that the overlap judge leaves out.
JUDGE_STOPWORDS = """
a an and are as at be by for from in is it of on or that the to was were with what
which who why how does did do this these those there their its not no
""".split()


#: What is left of a citation, white space that goes before a closing mark, an address, and how a sentence ends.
EMPTY_CITATION = r"\s*[\[(][\s,;]*[\])]"
BEFORE_MARK = r"\s+([,.;:!?)\]])"
URL = r"https?://[^\s)>\]]+"
SENTENCE_END = r"""[.!?][)"'\]]?$|\]$"""


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Words and numbers, matched first and lower-cased then, less ``STOPWORDS``; order and repeats stay."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9\-']*|\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: ~w.isin(STOPWORDS))


def normalise(text: Column) -> Column:
    """White space to one blank, empty citation brackets out with what is before them, none before closing marks, stripped."""
    text = F.regexp_replace(text, "(?U)" + EMPTY_CITATION, "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return strip(F.regexp_replace(text, "(?U)" + BEFORE_MARK, "$1"))


def blocks(text: Column, separator: str = "\n\n") -> Column:
    """``char_start``, ``char_end`` and ``text`` of the pieces between separators, trimmed, blank ones left out."""
    pieces = F.split(text, separator)
    bare = F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), (F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))).alias("lead"), strip(p).alias("text")))
    none = F.array().cast("array<struct<char_start:bigint,char_end:bigint,text:string>>")

    def laid(acc: Column, p: Column) -> Column:
        start = (acc["at"] + p["lead"]).cast("long")
        one = F.array(F.struct(start.alias("char_start"), (start + F.length(p["text"])).alias("char_end"), p["text"].alias("text")))
        return F.struct((acc["at"] + p["size"] + len(separator)).cast("long").alias("at"), F.when(p["text"] != "", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(bare, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), laid, lambda acc: acc["out"])


def same_refusal(answer: Column, refusal: Column) -> Column:
    """Whether an answer is the refusal but for outer white space and trailing dots; an empty refusal matches nothing."""
    bare = lambda c: F.rtrim(strip(c), F.lit("."))
    return (bare(refusal) != "") & (bare(answer) == bare(refusal))


def judge_terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9.]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(JUDGE_STOPWORDS) & (F.length(w) > 1)))


def share_of(part: Column, whole: Column) -> Column:
    """The share of ``whole`` that is in ``part``; 0 where it is empty."""
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole)).otherwise(F.lit(0.0))


def band(share: Column) -> Column:
    return F.when(share >= 0.8, 5.0).when(share >= 0.6, 4.0).when(share >= 0.4, 3.0).when(share >= 0.2, 2.0).otherwise(1.0)
