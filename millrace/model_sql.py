"""SQL of the queries whose models' answers follow from the prompt's digest."""

from __future__ import annotations

from .sql_text import BOILERPLATE, NL, QUESTIONS, STRIP, quoted

_CLUSTERS = f"""
WITH span AS (
  SELECT doc_id, doc_id // 3 AS c, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS k, 'd/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS path, n_chars, text,
    CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['doc', lang] END AS tags FROM documents
), cluster AS (
  SELECT c, string_agg('Span ' || k || ':' || {NL} || 'Path: ' || path || {NL} || 'Lines: 1-' || n_chars || {NL} || 'Tags: ' || CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, ', ') END || {NL} || 'Content:' || {NL} || {STRIP.format('text')} || {NL}, {NL} ORDER BY k) AS ctx,
    string_agg(path, ',' ORDER BY k) AS files, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM span GROUP BY c
), called AS (
  SELECT files, tags, md5({quoted('Create a JSON object with keys: conversation_id, turns (list of {role, content, evidence, metadata}), summary (with keys bullet_points, data_quality, risk_notes). Use the provided context strictly.')} || {NL} || {NL} || 'Context:' || {NL} || ctx) AS d FROM cluster
), told AS (
  SELECT *, CASE WHEN d[2] IN ('0', '1', '2', '3') THEN '' ELSE d[1:12] END AS named FROM called WHERE d[1] NOT IN ('0', '1', '2', '3')
), said AS (
  SELECT *, 'Here it is:' || {NL} || '```json' || {NL} || '{{"conversation_id": "' || named || '", "turns": [{{"role": "user", "content": "' || d || '"}}, {{"content": "1800"}}], "summary": {{"risk_notes": "' || d[3] || '"}}}}' || {NL} || '```' AS s FROM told
), judged AS (
  SELECT *, CASE WHEN named = '' THEN 'cluster-' || sha256(s) ELSE named END AS conversation_id,
    md5({quoted("Review the following JSON conversation for factual accuracy and clarity. Respond with concise critique (or 'OK' if solid).")} || {NL} || {NL} || s) AS j FROM said
), made AS (
  SELECT *, CASE WHEN j[1] = '1' THEN '' ELSE 'OK ' || j || ' 400' END AS critique FROM judged WHERE j[1] <> '0'
)
"""
_TURNS = ", ".join(f"({i}, {quoted(t)}, {quoted(q)})" for i, (t, q) in enumerate(QUESTIONS))


def _answer(prompt: str, tokens: int) -> str:
    d = f"md5({prompt})"
    return f"CASE WHEN {d}[1] IN ('0', '1') THEN NULL WHEN {d}[1] = '2' THEN 'short' ELSE 'Answer ' || {d} || ' ' || repeat('with reasons ', 12) || '{tokens}' END"


_CHOSEN = f"{quoted('Answer this question about the following code. Be specific, use exact variable/function names, and include financial reasoning where relevant. Write 3-6 paragraphs.')} || {NL} || {NL} || 'Question: ' || question || {NL} || {NL} || 'Code:' || {NL} || ctx"
_REJECTED = f"""{quoted("Write a deliberately vague, generic, unhelpful answer to this question. Use AI-isms like 'it is important to note', 'this function handles', 'various operations'. Do NOT mention specific variable names, numbers, or financial concepts. Keep it to 2 sentences.")} || {NL} || {NL} || 'Question: ' || question"""
_DULL = " OR ".join(f"contains(lower(chosen), {quoted(p)})" for p in BOILERPLATE)


def _work_sql(where: str) -> str:
    return f"""
WITH span AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx, CASE WHEN doc_id % 2 = 0 THEN 'function_definition' ELSE 'markdown_section' END AS kind, lpad(doc_id::VARCHAR, 12, '0') || '.md' AS file,
    CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['doc', lang] END AS tags FROM documents {where}
), work AS (
  SELECT span.*, t AS question_type, replace(replace(x, '{{repo}}', 'corpus'), '{{name}}', 'f' || doc_id) AS question,
    'File: ' || file || {NL} || 'Type: ' || kind || {NL} || 'Lines: 1-' || n_chars || {NL} || 'Tags: ' || CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, ', ') END || {NL} || {NL} || substr(text, 1, 3500) AS ctx
  FROM span JOIN (VALUES {_TURNS}) q(k, t, x) ON k = idx % 6
), one AS (
  SELECT *, {_answer(_CHOSEN, 1200)} AS chosen FROM work
), two AS (
  SELECT *, coalesce({_DULL} OR length(chosen) < 150, true) AS dull FROM one
), answered AS (
  SELECT *, CASE WHEN NOT dull THEN {_answer(_REJECTED, 200)} END AS rejected FROM two
), judged AS (
  SELECT *, CASE WHEN chosen IS NULL THEN 'empty' WHEN dull THEN 'boilerplate' WHEN row_number() OVER (PARTITION BY dull, question, chosen ORDER BY idx) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM answered
)
"""


_KEPT = _work_sql(rf"WHERE length({STRIP.format('text')}) >= 400")

ORACLES: dict[str, str] = {
    "l1_conversations": _CLUSTERS + "SELECT conversation_id, files, tags, 2 AS n_turns, d AS said, 'assistant' AS second_role, '1800' AS second_said, d[3] AS risk, critique FROM made",
    "k3_semantic_splits": _CLUSTERS + "SELECT conversation_id, files, critique, CASE WHEN row_number() OVER (ORDER BY conversation_id, files) <= (count(*) OVER ()) // 10 THEN 'valid' ELSE 'train' END AS split FROM made",
    "l4_answers": _work_sql("") + "SELECT idx, question_type, md5(ctx) AS context_md5, chosen, rejected, status FROM judged",
    "o3_work_limit": _work_sql("") + "SELECT idx, 'd/' || file AS source_path, question FROM work WHERE idx < 200",
    "k6_formats": _KEPT + f"""
SELECT format, file AS source_file, question_type, '1-' || n_chars AS lines, array_to_string(tags, ',') AS tags, md5(CASE format
  WHEN 'sft' THEN question || '|' || chosen WHEN 'dpo' THEN question || '|' || chosen || '|' || coalesce(rejected, 'This code handles various operations related to ' || replace(kind, '_', ' ') || '.') ELSE question || '|' || substr(text, 1, 3000) END) AS said_md5
FROM judged, (VALUES ('sft'), ('dpo'), ('grpo')) f(format) WHERE status = 'kept'""",
    "k7_format_stats": _KEPT + """
, n AS (SELECT count(*) FILTER (WHERE status = 'kept') AS total, count(*) FILTER (WHERE status <> 'kept') AS skipped FROM judged)
SELECT format, total, total * 9 // 10 AS train, total * 95 // 100 - total * 9 // 10 AS valid, total - total * 95 // 100 AS test, total AS success, skipped FROM n, (VALUES ('sft'), ('dpo'), ('grpo')) f(format)""",
    "v5_embedding_cache": """
WITH even AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, length(d.text)::BIGINT AS length, ('0x' || md5(d.text)[1:6])::BIGINT AS code, even.text IS NOT NULL AS cached, 1 AS entries FROM documents d LEFT JOIN even ON d.text = even.text""",
}
