"""The same results in DuckDB's SQL. White space and line ends are those that the tables hold."""

from __future__ import annotations

from . import model_sql, table_queries
from .sql_text import BOILERPLATE, NL, QUESTIONS, STRIP, quoted

#: Fixed values, written out here once more so that a change of the library's own shows.
_MD_SYSTEM = "You are a documentation assistant."
_MD_QUESTIONS = (
    ("What is ", "? Provide a concise explanation based only on this section."),
    ("What are the key inputs and outputs described in ", "?"),
    ("Summarize any policies, caveats, or limitations mentioned in ", "."),
    ("Describe the workflow/steps outlined in ", "."),
)
_REPO_SYSTEM = (
    "You are an expert in the `corpus` codebase. "
    "Answer questions about its code with deep technical precision, using exact variable and function names, "
    "explaining design decisions, tradeoffs, and implementation details clearly."
)
_VALIDATION_MARKS = ("assert ", "raise ", "ValueError", "TypeError", "KeyError")
_LOGGING_MARKS = ("logging.", ".debug(", ".info(", ".warning(", ".error(", ".exception(")
_KEYWORDS = {
    "factor": ("factor", "alpha", "exposure", "top20"),
    "regime": ("regime", "volatility", "dispersion", "momentum"),
    "optimizer": ("optimization", "target", "constraint", "solver"),
    "logging": ("logging.", "info(", "warning(", "error("),
    "validation": ("raise ", "valueerror", "assert "),
    "report": ("heatmap", "quilt", "chart", "report"),
}
_ASK = {
    "docstring": "Write a clear, concise docstring for the following Python code.",
    "jsdoc": "Write a JSDoc comment for the following JavaScript/TypeScript function.",
    "validation": "What inputs are validated and how? Summarize from the code (asserts and raises).",
    "errors": "Explain the error handling in this code. Which exceptions are caught and what happens?",
    "config": "Summarize the configuration constants defined in this module.",
    "logging": "Describe the logging flow: logger names, levels, and key messages.",
}

_WORDS = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']"


def _parts(window: int, overlap: int) -> str:
    step = window - overlap
    return f"unnest([array_to_string(w[p * {step} + 1:p * {step} + {window}], ' ') FOR p IN range(0, least(ceil(len(w) / {step}::DOUBLE)::INT, 33))])"


_QA = f"""
WITH d AS (
  SELECT doc_id, source, {STRIP.format('text')} AS t FROM documents
), words AS (
  SELECT *, [w FOR w IN regexp_split_to_array(t, '\\s+') IF w <> ''] AS w FROM d WHERE t <> ''
), cut AS (
  SELECT doc_id, source, CASE WHEN greatest(1, length(t) // 4) > 800 THEN [array_to_string(w[p * 680 + 1:p * 680 + 800], ' ') FOR p IN range(0, least(ceil(len(w) / 680.0)::INT, 33))] ELSE [t] END AS parts FROM words
), part AS (
  SELECT doc_id, source, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS p FROM cut
), question AS (
  SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)})' for i, (a, b) in enumerate(_MD_QUESTIONS))}) q(q, a, b)
), qa AS (
  SELECT doc_id, source, (p * 4 + q)::INT AS k, a || 'doc ' || doc_id || b || chr(10) || chr(10) || part AS said, part FROM part, question
)
"""

_FLAGSHIP = _QA + f"""
, told AS (
  SELECT *, (greatest(1, length({quoted(_MD_SYSTEM)}) // 4) + greatest(1, length(said) // 4) + greatest(1, length(part) // 4))::INT AS tokens FROM qa
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) AS n FROM told WHERE tokens BETWEEN 48 AND 4096
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY said, part ORDER BY doc_id, k) AS m FROM capped WHERE n <= 15
), placed AS (
  SELECT *, row_number() OVER (ORDER BY md5('17|' || doc_id || '-' || k), doc_id || '-' || k) - 1 AS position, count(*) OVER () AS c FROM kept WHERE m = 1
)
SELECT doc_id, k AS seq, 'md_section_qa' AS task, CASE WHEN position < greatest(1, floor(c * 0.1)) THEN 'valid' ELSE 'train' END AS split, tokens,
  md5('[{{"role":"system","content":' || to_json({quoted(_MD_SYSTEM)}) || '}},{{"role":"user","content":' || to_json(said) || '}},{{"role":"assistant","content":' || to_json(part) || '}}]') AS messages_md5
FROM placed
"""

_CODE = "text"
for _word, _mark in ((" the ", " raise "), (" and ", " logging."), (" de ", " ValueError "), (" of ", " .info("), (" der ", " assert ")):
    _CODE = f"replace({_CODE}, {quoted(_word)}, {quoted(_mark)})"


def _found(code: str, test: str, shown: str = "x") -> str:
    return f"""
WITH l AS (SELECT doc_id, [{shown} FOR x IN string_split({code}, chr(10)) IF {test}] AS f FROM documents)
SELECT doc_id, len(f)::INT AS n, md5(array_to_string(f, chr(10))) AS lines_md5 FROM l
"""


def _any(marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(x, {quoted(m)})" for m in marks) + ")"


_PLACED = "SELECT doc_id, source, row_number() OVER (ORDER BY md5('17|' || doc_id), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents"
_THIRDS = "CASE WHEN position < floor(n * 0.9) THEN 'train' WHEN position < floor(n * 0.95) THEN 'valid' ELSE 'test' END"
_TAGS = """
WITH t AS (
  SELECT doc_id, source, unnest(['de', 'die', 'of', 'the']) AS tag,
    unnest([contains(lower(text), ' de '), contains(lower(text), 'die ') OR contains(lower(text), 'der '), contains(lower(text), ' of '), contains(lower(text), 'the ') OR contains(lower(text), 'thea')]) AS has FROM documents
)
"""
_EXCHANGE = """
WITH e AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
), i AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM e
)
"""
_STATUS = _EXCHANGE + f"""
, j AS (
  SELECT *, CASE WHEN answer = '' THEN 'empty' WHEN {' OR '.join(f"contains(lower(answer), {quoted(p)})" for p in BOILERPLATE)} OR length({STRIP.format('answer')}) < 150 THEN 'boilerplate' ELSE 'kept' END AS s FROM i
), st AS (
  SELECT *, CASE WHEN s = 'kept' AND row_number() OVER (PARTITION BY s, md5(question || '|||' || answer) ORDER BY idx) > 1 THEN 'duplicate' ELSE s END AS status FROM j
)
"""
_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])) = 0 THEN 1 ELSE sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])) END) AS u FROM embeddings"
_MD_LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || '## ') AS t FROM documents)
), h AS (
  SELECT *, sum(regexp_matches(s, '^#{1,6}\\s')::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g, regexp_matches(s, '^#{1,6}\\s') AS head FROM l
), sec AS (
  SELECT doc_id, g, coalesce(max(CASE WHEN head THEN trim(regexp_replace(s, '^[# ]+', '')) END), '') AS title, trim(coalesce(string_agg(CASE WHEN NOT head THEN s END, chr(10) ORDER BY p), ''), ' ' || chr(10)) AS content FROM h GROUP BY doc_id, g
), full_sec AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS k FROM sec WHERE content <> ''
)
"""
_ITEMS = _MD_LINES + f"""
, f AS (SELECT 'd/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS item_seq, CASE WHEN title = '' THEN 'Section' ELSE title END AS title, content AS t FROM full_sec
), words AS (
  SELECT *, [w FOR w IN regexp_split_to_array(t, '\\s+') IF w <> ''] AS w FROM f
), cut AS (
  SELECT path, item_seq, title, CASE WHEN greatest(1, length(t) // 4) > 800 THEN [array_to_string(w[p * 680 + 1:p * 680 + 800], ' ') FOR p IN range(0, least(ceil(len(w) / 680.0)::INT, 33))] ELSE [t] END AS parts FROM words
), part AS (
  SELECT path, item_seq, title, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS p FROM cut
), question AS (
  SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)})' for i, (a, b) in enumerate(_MD_QUESTIONS))}) q(q, a, b)
), qa AS (
  SELECT path, item_seq, (p * 4 + q)::INT AS sub_seq, title, a || title || b || chr(10) || chr(10) || part AS said, part FROM part, question
), told AS (
  SELECT *, (greatest(1, length({quoted(_MD_SYSTEM)}) // 4) + greatest(1, length(said) // 4) + greatest(1, length(part) // 4))::INT AS tokens FROM qa
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY item_seq, sub_seq) AS n FROM told WHERE tokens BETWEEN 48 AND 4096
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY said, part ORDER BY path, item_seq, sub_seq) AS m FROM capped WHERE n <= 15
)
SELECT path, item_seq::INT AS item_seq, sub_seq, title, tokens FROM kept WHERE m = 1
"""
def _tags_of(said: str, kind: str) -> str:
    """Tags of a text and a kind of span, sorted and joined."""
    tests = {tag: "(" + " OR ".join(f"contains(lower({said}), {quoted(w)})" for w in words) + ")" for tag, words in _KEYWORDS.items()}
    tests["logging"] = f"({tests['logging']} OR {kind} = 'logging_call')"
    tests["config"] = f"({kind} = 'module_constant')"
    return "array_to_string(list_sort([x.t FOR x IN [" + ", ".join(f"{{'t': '{tag}', 'k': {test}}}" for tag, test in sorted(tests.items())) + "] IF x.k]), ',')"


_PLAIN = "regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g')"


def _code_of(*lines: str) -> str:
    """An expression for lines; {i} and {s} stand for the document's id and its plain text, {l} for its language."""
    out = []
    for line in lines:
        said = quoted(line).replace("{i}", "' || doc_id || '").replace("{s}", "' || s || '").replace("{l}", "' || lang || '")
        out.append(said)
    return f" || {NL} || ".join(out)


_QUOTES = '"' * 3
_T1_CODE = _code_of('"""{s} about"""', "", "", "def f{i}(x):", '    """{l}"""', "    return x", "", "", "class C{i}(Base):", "    @property", "    def m(self):", "        return 1", "")
_T1_DEF = _code_of("def f{i}(x):", '    """{l}"""', "    return x")
_T1_CLASS = _code_of("class C{i}(Base):", "    @property", "    def m(self):", "        return 1")
_T1_METHOD = _code_of("    def m(self):", "        return 1")
_T1 = f"""
WITH c AS (SELECT doc_id, lang, {_PLAIN} AS s FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT doc_id, 0 AS seq, 'Module' AS kind, NULL AS name, trim(s || ' about', ' ') AS d, {_T1_CODE} AS c FROM c
  UNION ALL SELECT doc_id, 1, 'FunctionDef', 'f' || doc_id, lang, {_T1_DEF} FROM c
  UNION ALL SELECT doc_id, 2, 'ClassDef', 'C' || doc_id, '', {_T1_CLASS} FROM c
  UNION ALL SELECT doc_id, 3, 'FunctionDef', 'm', '', {_T1_METHOD} FROM c
)
SELECT doc_id, seq::INT AS seq, kind, name, md5(d) AS docstring_md5, md5(c) AS code_md5 FROM i
"""
_JS = _code_of("export function f{i}(a, b) {{", "  if (a) {{ return b; }}", "}}").replace("{{", "{").replace("}}", "}")
_T2 = f"""
WITH c AS (SELECT doc_id, lang, {_PLAIN} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS seq, 'Function' AS kind, 'f' || doc_id AS name, md5(rtrim('* ' || s, ' ')) AS jsdoc_md5, md5({_JS}) AS code_md5 FROM c
"""
_T6_BODY = _code_of("def f{i}(x):", '    y = "{s}"', "", "    return y")
_T6_TAGS = _tags_of("content", "'function_definition'")
_T6 = f"""
WITH c AS (SELECT doc_id, lang, {_PLAIN} AS s FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, lang, {_T6_BODY} AS body FROM c WHERE length({_T6_BODY}) >= 400),
e AS (SELECT doc_id, '# File: f' || doc_id || '.py' || {NL} || '# Context: {_QUOTES}' || lang || ' notes{_QUOTES}' || {NL} || {NL} || body AS content FROM b)
SELECT 'd/f' || doc_id || '.py' AS source_path, 0 AS seq, 'function_definition' AS kind, 4 AS line_start, 7 AS line_end, 'f' || doc_id AS named, {_T6_TAGS} AS tags, md5(content) AS content_md5 FROM e
"""
_T10_TAGS = _tags_of("content", "'markdown_section'")
_T10 = f"""
WITH t AS (
  SELECT doc_id, string_split(replace(regexp_replace(text, '[^A-Za-z0-9 .,' || {NL} || ']', ' ', 'g'), '.' || {NL}, '.' || {NL} || '## '), {NL}) AS a FROM documents WHERE text IS NOT NULL
), cut AS (
  SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM t
), l AS (
  SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS p FROM cut
), g AS (
  SELECT *, sum(starts_with(s, '## ')::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM l
), sec AS (
  SELECT doc_id, k, min(p) AS line_start, max(p) AS line_end, trim(string_agg(s, {NL} ORDER BY p), ' ' || {NL}) AS content, arg_min(s, p) AS head FROM g GROUP BY doc_id, k
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS m FROM sec) WHERE k >= 2 OR k = m
)
SELECT 'd/' || doc_id || '.md' AS source_path, seq::INT AS seq, 'markdown_section' AS kind, line_start::INT AS line_start, line_end::INT AS line_end, CASE WHEN k = 0 THEN 'Document' ELSE ltrim(head, '# ') END AS named, {_T10_TAGS} AS tags, md5(content) AS content_md5 FROM kept
UNION ALL
SELECT 'd/' || doc_id || '.md', 0, 'markdown_section', 1, 0, 'Document', '', md5('') FROM cut WHERE len(a) = 0
"""
_FUNCTION = _code_of("def f{i}(x):", '    """{s}"""', "    assert x", "    try:", "        logging.info(x)", "    except E:", "        b = 1", "", "    return b")
_CHUNK = _code_of("def f{i}(x):", '    """{s}"""', "    assert x", "    try:", "        logging.info(x)", "    except E:", "        b = 1")


def _lines_of(test: str, shown: str = "x") -> str:
    return f"array_to_string([{shown} FOR x IN string_split(code, {NL}) IF {test}], {NL})"


def _ask(name: str) -> str:
    return f"{quoted(_ASK[name])} || {NL} || {NL} || "


_RECORDS = f"""
WITH c AS (
  SELECT doc_id, lang, {_PLAIN} AS s, doc_id % 3 AS turn FROM documents WHERE text IS NOT NULL
), py AS (
  SELECT *, 'd/' || doc_id || '.py' AS path, {_FUNCTION} AS code, {_CHUNK} AS chunk FROM c WHERE turn = 0
), js AS (
  SELECT *, 'd/' || doc_id || '.js' AS path, {_JS} AS code FROM c WHERE turn = 1
), md AS (
  SELECT doc_id, 'd/' || doc_id || '.md' AS path, trim(s, ' ') AS t FROM c WHERE turn = 2 AND trim(s, ' ') <> ''
), words AS (
  SELECT *, [w FOR w IN string_split(t, ' ') IF w <> ''] AS w FROM md
), cut AS (
  SELECT doc_id, path, CASE WHEN greatest(1, length(t) // 4) > 800 THEN [array_to_string(w[p * 680 + 1:p * 680 + 800], ' ') FOR p IN range(0, ceil(len(w) / 680.0)::INT)] ELSE [t] END AS parts FROM words
), part AS (
  SELECT doc_id, path, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS p FROM cut
), question AS (
  SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(a)}, {quoted(b)})' for i, (a, b) in enumerate(_MD_QUESTIONS))}) q(q, a, b)
), r AS (
  SELECT path, 0 AS item_seq, 0 AS builder_seq, 0 AS sub_seq, 'py_docstring_from_code' AS task, {_ask("docstring")} code AS said, trim(s, ' ') AS told FROM py WHERE trim(s, ' ') <> ''
  UNION ALL SELECT path, 0, 1, 0, 'py_chunk_explain', 'Explain the following Python code chunk from f' || doc_id || '. Focus on what it does and why.' || {NL} || {NL} || chunk, chunk FROM py
  UNION ALL SELECT path, 0, 2, 0, 'py_validation_summary', {_ask("validation")} code, {_lines_of(_any(_VALIDATION_MARKS))} FROM py
  UNION ALL SELECT path, 0, 3, 0, 'py_error_handling_summary', {_ask("errors")} code, {_lines_of("starts_with(trim(x, ' '), 'except ') OR starts_with(trim(x, ' '), 'try:')")} FROM py
  UNION ALL SELECT path, 0, 4, 0, 'py_logging_flow_summary', {_ask("logging")} {_lines_of(_any(_LOGGING_MARKS), "trim(x, ' ')")}, {_lines_of(_any(_LOGGING_MARKS), "trim(x, ' ')")} FROM py
  UNION ALL SELECT path, 1, 5, 0, 'py_config_constants_summary', {_ask("config")} 'MAX_' || doc_id || ' = 1', 'MAX_' || doc_id || ' = 1' FROM py
  UNION ALL SELECT path, 0, 0, 0, 'js_jsdoc_from_code', {_ask("jsdoc")} code, rtrim('* ' || s, ' ') FROM js
  UNION ALL SELECT path, 0, 0, p * 4 + q, 'md_section_qa', a || 'T' || doc_id || b || {NL} || {NL} || part, part FROM part, question
)
"""
_T4 = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, string_split(replace(text, '. ', {NL} || {NL}), {NL}) AS a FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT doc_id, a, [i FOR i IN range(1, len(a) + 1) IF trim(a[i], ' ') = ''] AS blank FROM l
), step AS (
  SELECT doc_id, a, blank, 1::BIGINT AS s, coalesce([i FOR i IN blank IF i >= 1 + 6][1], len(a) + 1) AS e, 1 AS k FROM b
  UNION ALL
  SELECT doc_id, a, blank, e + 1, coalesce([i FOR i IN blank IF i >= e + 1 + 6][1], len(a) + 1), k + 1 FROM step WHERE k < 5 AND e <= len(a)
), chunk AS (
  SELECT doc_id, k, trim(array_to_string(a[s:e - 1], {NL}), ' ' || {NL}) AS said FROM step WHERE e - s >= 6
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS k, md5(said) AS chunk_md5 FROM chunk WHERE said <> ''
"""
_MARKED = "text"
for _word, _mark in ((" the ", " FACTOR "), (" and ", " solver "), (" de ", " regime "), (" of ", " chart "), (" der ", " raise "), (" die ", " info(")):
    _MARKED = f"replace({_MARKED}, {quoted(_word)}, {quoted(_mark)})"
_V1 = f"""
WITH t AS (SELECT doc_id, {_MARKED} AS said, ['logging_call', 'module_constant', 'markdown_section'][doc_id % 3 + 1] AS kind FROM documents)
SELECT doc_id, {_tags_of("said", "kind")} AS tags FROM t
"""
_SHOWN = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE printf('%.10g', {0}) END"
_C5 = f"""
WITH v AS (SELECT p_partkey, p_partkey % 5 AS k, [(p_size + 2) * 3.0, p_size / 4.0, -p_size - 0.5, NULL, 0.09][p_partkey % 5 + 1]::DOUBLE AS x FROM part)
SELECT p_partkey, CASE WHEN k = 3 THEN 'Cannot divide by zero' ELSE {_SHOWN.format('x')} END AS display FROM v
"""
_TURNS = ", ".join(f"({i}, {quoted(t)}, {quoted(q)})" for i, (t, q) in enumerate(QUESTIONS))
_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
_CALC = "CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice + l_discount WHEN 1 THEN l_extendedprice - l_discount WHEN 2 THEN l_extendedprice * l_discount ELSE CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END END"

ORACLES: dict[str, str] = {
    "flagship": _FLAGSHIP,
    "n1_token_count": "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents",
    "n2_lines": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), m AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l)
SELECT doc_id, len(a)::INT AS n_lines, a[-1] AS last_line FROM m""",
    "n3_strip": rf"SELECT doc_id, length({STRIP.format('text')})::INT AS n FROM documents",
    "n4_words": f"SELECT doc_id, len({_WORDS})::INT AS n_words, md5(array_to_string({_WORDS}, ' ')) AS words_md5 FROM documents",
    "n6_case": "WITH f AS (SELECT doc_id, string_split(text, ' ')[1] AS f FROM documents) SELECT doc_id, upper(f) = f AND lower(f) <> f AS upper, regexp_matches(f, '^\\p{L}') AS alpha FROM f",
    "n9_slices": "SELECT doc_id, substr(text, 1, 300) AS head, md5(substr(text, 1, 3500)) AS context_md5 FROM documents",
    "n14_tolerant_json": "SELECT event_id, event_id % 3 <> 2 AS parsed, CASE WHEN event_id % 3 <> 2 THEN (props::JSON->>'k')::BIGINT END AS k FROM events",
    "n16_paths": f"""
WITH p AS (SELECT page_id, string_split({_URL_PATH}, '/')[-1] AS n FROM pages), s AS (SELECT *, regexp_extract(n, '^.+?(\\.[^.]+)$', 1) AS x FROM p)
SELECT page_id, n AS name, x AS suffix, substr(n, 1, length(n) - length(x)) AS stem FROM s""",
    "n17_repository_name": "SELECT page_id, replace(string_split(url || '.git', '/')[-1], '.git', '') AS name FROM pages",
    "t3_md_sections": _MD_LINES + "SELECT doc_id, k::INT AS k, title, md5(content) AS content_md5 FROM full_sec",
    "t1_py_items": _T1,
    "t2_js_items": _T2,
    "t4_blank_chunks": _T4,
    "t6_py_spans": _T6,
    "t10_md_spans": _T10,
    "p9_records": _RECORDS + "SELECT path, item_seq::INT AS item_seq, builder_seq::INT AS builder_seq, sub_seq::INT AS sub_seq, task, md5(said) AS user_md5, md5(told) AS assistant_md5 FROM r",
    "p10_meta": _RECORDS + r"""
SELECT path, item_seq::INT AS item_seq, builder_seq::INT AS builder_seq, sub_seq::INT AS sub_seq, '/src' AS repo_path, path AS meta_path, 'c0ffee' AS sha, task,
  CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'markdown' END AS source_type,
  CASE WHEN path LIKE '%.md' THEN 'T' || regexp_extract(path, '[0-9]+') END AS title, CASE WHEN task = 'py_chunk_explain' THEN 'f' || regexp_extract(path, '[0-9]+') END AS name FROM r""",
    "u1_union_builders": _RECORDS + "SELECT task, count(*) AS n FROM r GROUP BY task",
    "v1_default_tags": _V1,
    "n15_json_defaults": """
WITH t AS (SELECT conv_id, turn, unnest([text, '']) AS said, unnest([0, 1]) AS k FROM conversations)
SELECT conv_id, turn, k::INT AS k, 'assistant' AS role, md5(said) AS content_md5, 0 AS n_evidence, 0 AS n_metadata FROM t""",
    "k1_jsonl": "SELECT conv_id, turn, role, md5(text) AS text_md5, conv_id || '-' || turn AS key FROM conversations",
    "c3_number_format": f"SELECT p_partkey, {_SHOWN.format('p_retailprice')} AS shown, p_size::VARCHAR AS size FROM part",
    "c5_keys": _C5,
    "t5_word_windows": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, [array_to_string(w[p * 60 + 1:p * 60 + 100], ' ') FOR p IN range(0, least(ceil(len(w) / 60.0)::INT, 33))] AS a FROM d)
SELECT doc_id, (generate_subscripts(a, 1) - 1)::INT AS k, md5(unnest(a)) AS part_md5 FROM c""",
    "p0_chat_messages": _EXCHANGE + "SELECT conv_id, turn, md5('system: Be brief.' || chr(10) || 'user: ' || question || chr(10) || 'assistant: ' || answer) AS messages_md5 FROM i",
    "p3_section_qa": _QA + "SELECT doc_id, k, md5(said) AS user_md5, md5(part) AS assistant_md5 FROM qa",
    "p5_validation_lines": _found(_CODE, _any(_VALIDATION_MARKS)),
    "p6_error_lines": _found("replace(replace(text, chr(10) || 'The ', chr(10) || '  except '), chr(10) || 'Of ', chr(10) || 'try: ')", "starts_with(trim(x), 'except ') OR starts_with(trim(x), 'try:')"),
    "p7_constant_lines": _found("upper(replace(replace(text, ' ', '='), 'ß', ''))", "contains(x, '=') AND regexp_matches(x, '^\\p{L}') AND upper(string_split(x, '=')[1]) = string_split(x, '=')[1] AND lower(string_split(x, '=')[1]) <> string_split(x, '=')[1]", "trim(x)"),
    "p8_logging_lines": _found(_CODE, _any(_LOGGING_MARKS), "trim(x)"),
    "p13_span_context": "SELECT doc_id, 'a.b' AS name, md5('File: a.b.md' || chr(10) || 'Type: markdown_section' || chr(10) || 'Lines: 1-' || n_chars || chr(10) || 'Tags: ' || lang || chr(10) || chr(10) || substr(text, 1, 3500)) AS context_md5 FROM documents",
    "p14_question_rotation": f"""
WITH i AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT doc_id, t AS question_type, replace(replace(x, '{{repo}}', 'corpus'), '{{name}}', source || '.f') AS question FROM i JOIN (VALUES {_TURNS}) q(k, t, x) ON k = idx % 6""",
    "p15_sft": _STATUS + f"SELECT idx, md5('system=' || {quoted(_REPO_SYSTEM)} || '|user=' || question || '|assistant=' || answer) AS messages_md5, conv_id || '.py' AS source_file, '1-2' AS lines FROM st WHERE status = 'kept'",
    "p15_dpo": _STATUS + "SELECT idx, question AS prompt, answer AS chosen, CASE WHEN idx % 2 = 0 THEN 'This code handles various operations related to function definition.' ELSE 'no' END AS rejected FROM st WHERE status = 'kept'",
    "p15_grpo": _STATUS + "SELECT idx, question AS prompt, substr(question, 1, 3000) AS reference FROM st WHERE status = 'kept'",
    "f1_token_budget": "WITH t AS (SELECT conv_id, sum(greatest(1, length(text) // 4))::INT AS tokens FROM conversations GROUP BY conv_id) SELECT conv_id, tokens, tokens BETWEEN 48 AND 4096 AS kept, tokens <= 400 AS within FROM t",
    "f5_meaningful": rf"SELECT doc_id, doc_id % 2 = 0 AND length({STRIP.format('text')}) >= 400 AS kept FROM documents",
    "f6_boilerplate": rf"SELECT doc_id, length({STRIP.format('text')}) < 150 OR {' OR '.join(f'contains(lower(text), {quoted(p)})' for p in BOILERPLATE)} AS boilerplate FROM documents",
    "f9_redaction": "SELECT doc_id, md5(regexp_replace(text, '[0-9]{3,}', '#', 'g')) AS clean_md5 FROM documents",
    "w1_file_cap": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE greatest(1, length(text) // 4) BETWEEN 48 AND 4096) WHERE n <= 15",
    "a1_dedupe_exact": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "a2_dedupe_md5": _EXCHANGE + "SELECT conv_id, turn, md5(question || '|||' || answer) AS answer_key FROM (SELECT *, row_number() OVER (PARTITION BY question, answer ORDER BY conv_id, turn) AS n FROM i) WHERE n = 1",
    "a4_answer_status": _STATUS + "SELECT status, count(*) AS n FROM st GROUP BY status",
    "a6_centroid": f"WITH u AS ({_UNIT}), e AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS i FROM u) SELECT label, i::INT AS i, round(avg(x), 6) AS x FROM e GROUP BY label, i",
    "a7_tag_union": _TAGS + ", g AS (SELECT DISTINCT source, tag FROM t WHERE has) SELECT source, string_agg(tag, ',' ORDER BY tag) AS tags FROM g GROUP BY source",
    "a9_spans_by_file": "SELECT source AS source_path, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, doc_id FROM documents",
    "u3_tag_merge": _TAGS + "SELECT doc_id, 'of,old' || coalesce(',' || string_agg(tag, ',' ORDER BY tag) FILTER (WHERE has AND tag <> 'of'), '') AS tags FROM t GROUP BY doc_id",
    "u4_cache_anti": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents",
    "v1_tags": _TAGS + "SELECT doc_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (WHERE has), '') AS tags FROM t GROUP BY doc_id",
    "v2_normalize": f"WITH u AS ({_UNIT}) SELECT vec_id, (generate_subscripts(u, 1) - 1)::INT AS i, round(unnest(u), 6) AS x FROM u",
    "v4_clusters": f"""
WITH u AS ({_UNIT}), g AS (SELECT label, count(*)::INT AS n, string_agg(DISTINCT 't' || vec_id % 3, ',' ORDER BY 't' || vec_id % 3) AS tags, string_agg(DISTINCT 'f' || vec_id % 7, ',' ORDER BY 'f' || vec_id % 7) AS files, round(avg(u[1]), 6) AS x0 FROM u WHERE label <> 0 GROUP BY label)
SELECT 'cluster-' || label AS cluster_id, n, tags, files, x0 FROM g
UNION ALL SELECT 'singleton-' || row_number() OVER (ORDER BY vec_id), 1, 't' || vec_id % 3, 'f' || vec_id % 7, round(u[1], 6) FROM u WHERE label = 0""",
    "v6_cache_key": "SELECT doc_id, sha256(text || chr(31) || 'm') AS key FROM documents",
    "o5_split_hash": f"WITH p AS ({_PLACED}) SELECT doc_id, CASE WHEN position < greatest(1, floor(n * 0.1)) THEN 'valid' ELSE 'train' END AS split, position FROM p",
    "o6_split_prefix": "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN position < floor(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM p",
    "o7_split_905": f"WITH p AS ({_PLACED}) SELECT doc_id, {_THIRDS} AS split FROM p",
    "k2_stats": f"WITH p AS ({_PLACED}), s AS (SELECT source, {_THIRDS} AS split FROM p) SELECT source, count(*) AS total, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test FROM s GROUP BY source",
    "q1_filtered_records": _ITEMS,
    "c1_calc": f"""
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs({_CALC}) > 1e100 THEN NULL ELSE {_CALC} END, 4) AS value,
  CASE WHEN l_linenumber % 4 = 3 AND l_discount = 0 THEN 'Cannot divide by zero' WHEN abs({_CALC}) > 1e100 THEN 'Result too large' END AS error, round(l_tax / 100, 6) AS tax, ['+', '−', '×', '÷'][l_linenumber % 4 + 1] AS symbol
FROM lineitem""",
} | table_queries.ORACLES | model_sql.ORACLES
