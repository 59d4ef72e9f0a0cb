"""DuckDB SQL that gives the rows of the queries that SQL can express."""

#: Slot after slot, the released block with the earliest deadline; a state holds each source that still has blocks.
OP1 = """
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS place
  FROM documents
), sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS s, CAST(ceil(count(*) / 32.0) AS BIGINT) AS n,
         CAST(CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS BIGINT) AS w
  FROM documents GROUP BY source
), states AS (
  SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS start,
         list({'s': s, 'w': w, 'phase': CAST(0 AS BIGINT), 'done': CAST(0 AS BIGINT), 'n': n} ORDER BY s) AS left_
  FROM sources
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN slot + 1 ELSE start END,
         CASE WHEN ends
              THEN list_transform(list_filter(left_, lambda x: x.s <> pick.s), lambda x: {'s': x.s, 'w': x.w, 'phase': x.done, 'done': x.done, 'n': x.n})
              ELSE list_transform(left_, lambda x: {'s': x.s, 'w': x.w, 'phase': x.phase, 'done': x.done + CASE WHEN x.s = pick.s THEN 1 ELSE 0 END, 'n': x.n})
         END
  FROM (SELECT *, pick.done + 1 = pick.n AS ends FROM (
    SELECT slot, start, left_, list_sort(list_transform(
      list_filter(left_, lambda x: (x.done - x.phase) * total // x.w <= slot - start),
      lambda x: {'due': ((x.done - x.phase + 1) * total + x.w - 1) // x.w, 's': x.s, 'done': x.done, 'n': x.n, 'w': x.w, 'phase': x.phase}))[1] AS pick
    FROM (SELECT *, CAST(list_sum(list_transform(left_, lambda x: x.w)) AS BIGINT) AS total FROM states WHERE len(left_) > 0)))
), slots AS (
  SELECT slot, start, pick.s AS s, pick.done AS block, start + (pick.done - pick.phase) * total // pick.w AS release, start + pick.due AS deadline
  FROM (
    SELECT slot, start, total, list_sort(list_transform(
      list_filter(left_, lambda x: (x.done - x.phase) * total // x.w <= slot - start),
      lambda x: {'due': ((x.done - x.phase + 1) * total + x.w - 1) // x.w, 's': x.s, 'done': x.done, 'w': x.w, 'phase': x.phase}))[1] AS pick
    FROM (SELECT *, CAST(list_sum(list_transform(left_, lambda x: x.w)) AS BIGINT) AS total FROM states WHERE len(left_) > 0))
)
SELECT doc_id, ranked.source, block, release, deadline, slot, slot * 32 + place % 32 AS position
FROM ranked JOIN sources ON ranked.source IS NOT DISTINCT FROM sources.source JOIN slots ON slots.s = sources.s AND slots.block = place // 32
"""

OP10 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM counted)
), twice AS (
  SELECT k, unnest([i, i + 1, i + 2]) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT k, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY k
), plain AS (
  SELECT k, host, trim(regexp_replace(lower(unnest(lines)), '[^\p{L}\p{N}]+', ' ', 'g')) AS line FROM counted
), frequent AS (
  SELECT host, line FROM (SELECT DISTINCT k, host, line FROM plain WHERE line <> '') GROUP BY host, line HAVING count(*) > 10
), lost AS (
  SELECT plain.k, sum(len(plain.line) - len(replace(plain.line, ' ', '')) + 1) AS line_words,
         coalesce(sum(CASE WHEN frequent.line IS NOT NULL THEN len(plain.line) - len(replace(plain.line, ' ', '')) + 1 END), 0) AS removed
  FROM plain LEFT JOIN frequent ON plain.host IS NOT DISTINCT FROM frequent.host AND plain.line = frequent.line
  WHERE plain.line <> '' GROUP BY plain.k
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS removed_words, CAST(coalesce(line_words, 0) AS BIGINT) AS line_words
  FROM counted LEFT JOIN repeated USING (k) LEFT JOIN lost USING (k)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         2 * removed_words > line_words OR (removed_words > 0 AND line_words - removed_words < 50) AS depleted
  FROM measured
)
SELECT * EXCLUDE (line_words), NOT base_failed AND NOT depleted AS kept FROM judged
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT k, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), tfs AS (
  SELECT k, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY k, term
), sizes AS (
  SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY k
), totals AS (
  SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, N_
), scored AS (
  SELECT item_id, k, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_) // L)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (k), totals GROUP BY item_id, k
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op10_quality_rules": OP10, "op11_lexical_search": OP11}
