"""Queries on sheets for people: drawn items, notes, returned scores, cover by evidence and by paragraph, selected questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import answers, sheets
from evidentia.plans.catalogue import CELL, REFUSAL, SQL_ANSWERS, SQL_CHUNKS, SQL_GOLD, TARGETS, chunk_table, gold, held_docs, query, questions, selected, table
from evidentia.plans.checks import SQL_AUTHORED, authored
from evidentia.sources.tables import few, stored

#: How a sheet takes a note in, and how many items a sheet has.
TEMPLATE, SHEET = "Note: {judge_note}.", 40

_STRIPPED = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SENTENCES = lambda c: f"CASE WHEN {_STRIPPED(c)} = '' THEN 0 ELSE 1 + " + " + ".join(f"(length({_STRIPPED(c)}) - length(replace({_STRIPPED(c)}, '{m} ', ''))) // 2" for m in ".?!") + " END"
_NOTE = lambda c: f"CASE WHEN {_SENTENCES(c)} > 1 THEN CAST({_SENTENCES(c)} AS VARCHAR) || ' sentences -- the answer is stated in more than one place' ELSE '' END"
_SHOWN = lambda c: f"CASE WHEN {_NOTE(c)} = '' THEN '' ELSE 'Note: ' || {_NOTE(c)} || '.' END"


@query(f"SELECT item_id, {_NOTE('text')} AS contiguity, {_SHOWN('text')} AS note FROM benchmark")
def evidence_notes(spark, d):
    note = sheets.contiguity_note(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", note.alias("contiguity"), sheets.judge_note(note, TEMPLATE).alias("note"))


@query(
    f"""WITH {SQL_ANSWERS}, nm AS (SELECT *, chunking || '-' || embedding || '-' || rerank AS config FROM answered),
tn AS (SELECT *, sha256('7:' || config || ':' || item_id) AS h FROM nm), rk AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY h, item_id) AS turn FROM tn),
dr AS (SELECT * FROM rk ORDER BY turn, h LIMIT {SHEET})
SELECT left(sha256('item:' || config || ':' || item_id), 16) AS sheet_id, config, item_id, question, reference, {_SHOWN('reference')} AS note, answer, context FROM dr"""
)
def calibration_items(spark, d):
    contexts = stored(answers.context_text(selected(spark, d), CELL))
    asked = questions(spark, d).withColumn("note", sheets.judge_note(sheets.contiguity_note(F.col("reference")), TEMPLATE))
    answered = answers.extractive_answer(contexts.join(asked.select("item_id", "question"), "item_id"), REFUSAL)
    drawn = stored(sheets.draw_items(answered.select(*CELL, "answer"), CELL[:3], "item_id", SHEET))
    return sheets.sheet_items(drawn, asked, contexts, CELL[:3], "item_id")


#: What people wrote on a sheet, from the labels: blanks, other spellings, scores that are none.
_WRITTEN = {
    "item_id": "CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE ' i' || CAST(doc_id AS STRING) END",
    "verdict": "CASE WHEN toxic = 1 THEN ' Incorrect ' WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'good' WHEN quality = 1 THEN 'correct' ELSE 'ABSTAINED' END",
    "faithfulness": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'n/a' ELSE CAST(doc_id % 7 AS STRING) END",
    "relevance": "CASE WHEN quality = 1 THEN ' 4.5' WHEN doc_id % 11 = 0 THEN '5d' ELSE '' END",
    "completeness": "CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '3e0' ELSE '2.' END",
}
_SCORE = lambda s: f"CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({s} AS DOUBLE) END"
_FAULTS = " ".join(f"WHEN {s} <> '' AND n_{s} IS NULL THEN '{s} is no number' WHEN n_{s} NOT BETWEEN 1 AND 5 THEN '{s} is out of range'" for s in sheets.SCALES)


@query(
    f"""WITH wr AS (SELECT doc_id AS line, {", ".join(f"{rule.replace('STRING', 'VARCHAR')} AS {name}" for name, rule in _WRITTEN.items())} FROM labels),
ct AS (SELECT line, trim(item_id) AS item_id, lower(trim(verdict)) AS verdict, {", ".join(f"trim(coalesce({s}, '')) AS {s}" for s in sheets.SCALES)} FROM wr),
nu AS (SELECT *, {", ".join(f"{_SCORE(s)} AS n_{s}" for s in sheets.SCALES)} FROM ct WHERE item_id <> ''),
er AS (SELECT *, CASE WHEN verdict NOT IN ('', {", ".join(f"'{v}'" for v in sheets.VERDICTS)}) THEN 'unknown verdict ' || verdict {_FAULTS} END AS error FROM nu)
SELECT item_id, verdict, {", ".join(f"n_{s} AS {s}" for s in sheets.SCALES)}, error FROM er WHERE verdict <> '' OR error IS NOT NULL OR coalesce({", ".join(f"n_{s}" for s in sheets.SCALES)}) IS NOT NULL"""
)
def returned_scores(spark, d):
    written = table(spark, d, "labels").select(F.col("doc_id").alias("line"), *(F.expr(rule).alias(name) for name, rule in _WRITTEN.items()))
    return sheets.returned_scores(written)


_FIGURES = lambda v: ", ".join([f"round(avg({v}), 1) AS {v}_mean, CAST(min({v}) AS BIGINT) AS {v}_min, CAST(max({v}) AS BIGINT) AS {v}_max, round(stddev_pop({v}), 1) AS {v}_std", *(f"round(quantile_cont({v}, {q}), 1) AS {v}_{n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90")))])


@query(
    rf"""WITH {SQL_CHUNKS}, {SQL_GOLD},
lb AS (SELECT item_id, gold_doc, unnest(['evidence', 'paragraph']) AS label, unnest([gold_start, gold_start - length(regexp_extract(left(text, gold_start), '[^\n]*$'))]) AS s, unnest([gold_end, gold_end + length(regexp_extract(substr(text, gold_end + 1), '^[^\n]*'))]) AS e FROM gold JOIN documents ON doc_id = gold_doc),
gr AS (SELECT * FROM lb, (SELECT chunking FROM targets)),
cv AS (SELECT gr.chunking, gr.item_id, label, count(c.doc_id) AS n_cover, coalesce(round(sum(least(char_end, e) - greatest(char_start, s)) / max(e - s), 6), 0) AS ceiling, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS cover_tokens
  FROM gr LEFT JOIN chunks c ON c.chunking = gr.chunking AND c.doc_id = gold_doc AND char_start < e AND char_end > s GROUP BY ALL),
hi AS (SELECT chunking, label, string_agg(n_cover || ':' || k, ',' ORDER BY n_cover) AS histogram FROM (SELECT chunking, label, n_cover, count(*) AS k FROM cv GROUP BY ALL) GROUP BY ALL)
SELECT chunking, label, count(*) AS n_spans, count(*) FILTER (n_cover > 1) AS n_split, round(avg(ceiling), 6) AS mean_ceiling, any_value(histogram) AS histogram, {_FIGURES("n_cover")}, {_FIGURES("cover_tokens")} FROM cv JOIN hi USING (chunking, label) GROUP BY chunking, label"""
)
def cover_by_label(spark, d):
    g = stored(gold(spark, d))
    labels = stored(sheets.with_lines(few(g), held_docs(spark, d, g)))
    return sheets.cover_report(chunk_table(spark, d, held_docs(spark, d, g)), labels, list(TARGETS))


@query(
    rf"""WITH {SQL_AUTHORED} SELECT item_id, array_to_string(list_filter(string_split_regex(b.text, '\s'), lambda w: w <> '')[1:12], ' ') AS question, b.text AS reference, note, gold_doc, gold_start, gold_end, verified
FROM au JOIN gold USING (item_id) JOIN benchmark b USING (item_id) WHERE selected"""
)
def selected_questions(spark, d):
    rows = authored(spark, d).join(gold(spark, d), "item_id").join(questions(spark, d), "item_id")
    return sheets.selected_questions(rows).select("item_id", "question", "reference", "note", "gold.*", "verified")
