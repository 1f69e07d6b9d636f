"""The registered queries of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from catalog.registry import query, table
from gridmine.llm import chat, decontaminate, line_rules, mixing, ngram_join, odd_sketch, periodic_runs, pii, quality, suffix_dedup, token_files, toxicity, turn_repair


@query("op1_token_files")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_files(table(spark, sf, "documents"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(
    "op3_contamination",
    f"""
    WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
    items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
    windows AS (
      SELECT item_id, len(w) AS n, w AS win FROM items WHERE len(w) BETWEEN 1 AND 9
      UNION
      SELECT item_id, 10 AS n, w[i:i + 9] AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10)),
    lengths AS (SELECT DISTINCT n FROM windows),
    grams AS (
      SELECT doc_id, n, i, w[i:i + n - 1] AS win
      FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
    hits AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x USING (n, win)),
    hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    hit_items AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op5_chat_documents",
    """
    WITH turns AS (
      SELECT conv_id, turn, role, text,
             CASE WHEN role IS NULL THEN '-' ELSE strlen(role) || ':' || role END
             || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS piece
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT conv_id, count(*) AS n_turns,
             list(piece ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pieces,
             string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
      FROM turns GROUP BY conv_id),
    prefixes AS (SELECT DISTINCT pieces[1:k] AS pieces FROM (SELECT pieces, unnest(range(1, len(pieces))) AS k FROM convs)),
    whole AS (SELECT pieces, min(conv_id) AS conv_id, count(*) AS n_equal FROM convs GROUP BY pieces)
    SELECT w.conv_id, c.n_turns, w.n_equal, c.rendered
    FROM (SELECT * FROM whole WHERE pieces NOT IN (SELECT pieces FROM prefixes)) w JOIN convs c USING (conv_id)
    """,
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return chat.chat_documents(table(spark, sf, "conversations"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "op6_line_rules",
    rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    repeats AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)
      GROUP BY doc_id),
    lines AS (
      SELECT doc_id, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
    figures AS (
      SELECT doc_id, line, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars,
             length(line) - length(regexp_replace(line, {_sql_text(line_rules.SYMBOLS)}, '', 'g')) AS symbols,
             length(line) - length(replace(line, '|', '')) AS bars,
             len(list_filter(w, lambda x: ends_with(x, '!!'))) AS shouts,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same,
             regexp_matches(line, {_sql_text(line_rules.END_MARK)}) AS ended
      FROM lines WHERE len(w) > 0),
    judged AS (
      SELECT *, symbols > {line_rules.SYMBOL_SHARE} * chars OR shouts >= {line_rules.SHOUT_SHARE} * n
             OR bars >= 3 OR (n < {line_rules.SHORT_LINE} AND NOT ended)
             OR regexp_matches(line, {_sql_text(line_rules.BOILERPLATE)})
             OR (n > 3 AND same >= {line_rules.SAME_SHARE} * n) AS failed
      FROM figures),
    by_doc AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             sum(failed::INT)::BIGINT AS n_failed_lines, sum(CASE WHEN failed THEN 0 ELSE n END)::BIGINT AS kept_words
      FROM judged GROUP BY doc_id),
    base AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, {_sql_text(line_rules.SYMBOLS)}, '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(w) < {line_rules.LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {line_rules.REPEATED_PERCENT} * len(w) AS base_failed,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(kept_words, 0) AS kept_words
      FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN by_doc USING (doc_id))
    SELECT *, NOT base_failed AND n_words - kept_words <= {line_rules.MOST_LOST} * n_words AS kept FROM base
    """,
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.quality_digest(table(spark, sf, "documents"))


@query("op9_mixed_sources")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))


@query("op10_personal_data")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf, "documents"))


def _near_duplicates_sql(shingle: int, percent: int, more: str = "") -> str:
    """Shingle sets of whole texts, overlaps by a join on shingles, smallest id reachable over links."""
    return rf"""
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, least(len(w), 1) + 1))) AS i FROM d)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
      SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
      WHERE 100 * c >= {percent} * (s.n + t.n - c)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reached.doc_id, ways.y FROM reached JOIN ways ON ways.x = reached.r),
    lowest AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id{more}
    FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
    """


@query("op4_ngram_join", _near_duplicates_sql(4, 85))
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicate_digest(table(spark, sf, "documents"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digest(table(spark, sf, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf, "documents"))


#: crc32 of an ASCII text in SQL, by a table of the remainders of all bytes (``crc_table.t``).
_CRC_TABLE = """crc_table AS (
      SELECT list_transform(range(256), lambda n: list_reduce([n] || list_transform(range(8), lambda k: 0::BIGINT),
             lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"""


def _crc32(text: str) -> str:
    steps = f"list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: xor(crc // 256, t[xor(crc % 256, b) + 1]))"
    return f"xor({steps}, 4294967295)"


#: States of the form hold cost (nine digits) and edits as one text, so that the least text is the cheapest.
def _edit(state: str, cost: str, letter: str) -> str:
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}'"


def _row_edits(state: str, initial: str) -> str:
    kept = f"CASE WHEN NOT must_go AND initial = '{initial}' THEN {_edit(state, 'extra', 'K')} END"
    if initial == "s":
        return kept
    return f"{kept}, CASE WHEN NOT must_go THEN {_edit(state, '2 + extra', 'R')} END"


@query(
    "op11_turn_repair",
    rf"""
    WITH RECURSIVE {_CRC_TABLE},
    kinds AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
      FROM conversations, crc_table),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM kinds)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM damaged),
    turns AS (
      SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end,
             lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS following
      FROM numbered),
    faults AS (
      SELECT conv_id, rn, role, text, initial, blank OR again AS must_go, (open_end AND NOT blank AND NOT again)::BIGINT AS extra
      FROM turns),
    counts AS (
      SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (open_end AND NOT blank AND NOT again) AS truncated,
             count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
      FROM turns GROUP BY conv_id),
    states(conv_id, i, s0, s1, s2, s3) AS (
      SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000002I', '000000004II' FROM counts
      UNION ALL
      SELECT conv_id, i, n0, n1, c2, least(n3, {_edit("c2", "2", "I")})
      FROM (SELECT *, least(n2, {_edit("n0", "2", "I")}, {_edit("n1", "2", "I")}, {_edit("n3", "2", "I")}) AS c2
            FROM (SELECT s.conv_id, i + 1 AS i, {_edit("s0", "3", "D")} AS n0,
                         least({_edit("s1", "3", "D")}, {_row_edits("s0", "s")}) AS n1,
                         least({_edit("s2", "3", "D")}, {_row_edits("s0", "u")}, {_row_edits("s1", "u")}, {_row_edits("s3", "u")}) AS n2,
                         least({_edit("s3", "3", "D")}, {_row_edits("s2", "a")}) AS n3
                  FROM states s JOIN faults f ON f.conv_id = s.conv_id AND f.rn = s.i + 1))),
    best AS (
      SELECT c.*, left(least(s0, s3), 9)::BIGINT AS cost, substr(least(s0, s3), 10) AS audit
      FROM counts c JOIN states s ON s.conv_id = c.conv_id AND s.i = c.n),
    letters AS (
      SELECT conv_id, k, letter, count(*) FILTER (letter <> 'I') OVER so_far AS rn, count(*) FILTER (letter <> 'D') OVER so_far AS place
      FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS k FROM best WHERE audit <> '')
      WINDOW so_far AS (PARTITION BY conv_id ORDER BY k)),
    placed AS (
      SELECT l.*, f.role, f.text, max((place = 1 AND letter = 'K' AND initial = 's')::BIGINT) OVER (PARTITION BY l.conv_id) AS has_system
      FROM letters l LEFT JOIN faults f ON f.conv_id = l.conv_id AND f.rn = l.rn AND letter <> 'I' WHERE letter <> 'D'),
    repaired AS (
      SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                 || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body
      FROM placed GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
           coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repair_digest(table(spark, sf, "conversations"))


@query(
    "op12_periodic_runs",
    rf"""
    WITH {_CRC_TABLE},
    d AS (
      SELECT doc_id, w, len(w) AS n, {_crc32("doc_id::VARCHAR")} AS h
      FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), crc_table),
    starts AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM d),
    periods AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM starts),
    taken AS (
      SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w
      FROM periods),
    places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM taken),
    equals AS (
      SELECT x.doc_id, y.i - x.i AS q, x.i
      FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretches AS (
      SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equals) GROUP BY doc_id, q, island
      HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
    listed AS (
      SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS best
      FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    left_over AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
           (1000 * best.l // best.p)::BIGINT AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
    FROM taken LEFT JOIN listed USING (doc_id) LEFT JOIN left_over USING (doc_id)
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.periodic_runs_digest(table(spark, sf, "documents"))


@query("op13_odd_sketch", _near_duplicates_sql(4, 80, ", d.doc_id = coalesce(component_id, d.doc_id) AS kept"))
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return odd_sketch.near_duplicate_digest(table(spark, sf, "documents"))
