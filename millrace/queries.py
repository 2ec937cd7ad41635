"""The operators as queries over the given tables; keys start with the operators' numbers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model_queries, table_queries
from .config import ChatConfig
from .functions import arithmetic, paths, text, tolerant_json, vectors
from .operators import builders, cluster, dedupe, extract, filters, formats, sections, split, tags, windows
from .plans import chat, spans
from .sources import sinks
from .sources.cache import key as cache_key
from .sources.cache import split as cache_split
from .storage import read_table, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of a file for each source: windows, questions, budget, cap, first of equal exchanges, split."""
    qa = builders.md_section(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("text"))
    each = _docs(spark, sf_dir).select("doc_id", "source", F.posexplode(qa).alias("seq", "r")).select("doc_id", "source", "seq", F.col("r.task").alias("task"), F.col("r.messages").alias("messages"))
    each = each.withColumn("tokens", filters.message_tokens(F.col("messages"))).filter(F.col("tokens").between(48, 4096))
    capped = filters.file_cap(each, "source", ["doc_id", "seq"])
    kept = dedupe.dedupe_records(capped, ["doc_id", "seq"])
    parted = split.train_valid(kept.withColumn("key", F.concat_ws("-", "doc_id", "seq")), "key")
    return parted.select("doc_id", "seq", "task", "split", "tokens", F.md5(F.to_json("messages")).alias("messages_md5"))


def n1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


def n2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), F.element_at(lines, -1).alias("last_line"))


def n3_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(text.strip(F.concat(F.lit(" \t\n"), "text", F.lit("\r \n")))).alias("n"))


def n4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(text.words(F.col("text"))).alias("n_words"), F.md5(F.array_join(text.words(F.col("text")), " ")).alias("words_md5"))


def n6_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.split("text", " "), 1)
    return _docs(spark, sf_dir).select("doc_id", text.is_upper(first).alias("upper"), text.starts_alpha(first).alias("alpha"))


def n9_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 300).alias("head"), F.md5(F.substring("text", 1, 3500)).alias("context_md5"))


def n14_tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.concat("props", F.lit(" and "), "props"))
    parsed = tolerant_json.parse(noisy)
    return table(spark, sf_dir, "events").select("event_id", parsed.isNotNull().alias("parsed"), tolerant_json.field(parsed, "$.k", "bigint").alias("k"))


def n16_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.name(path).alias("name"), paths.suffix(path).alias("suffix"), paths.stem(path).alias("stem"))


def n17_repository_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.repository_name(F.concat("url", F.lit(".git/"))).alias("name"))


def t5_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.word_windows(F.col("text"), 100, 40)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(cut).alias("k", "part")).select("doc_id", "k", F.md5("part").alias("part_md5"))


def _markdown(column: str = "text") -> Column:
    """Documents have no headings: lines after a full stop become some."""
    return F.replace(F.col(column), F.lit(".\n"), F.lit(".\n## "))


def t3_md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.markdown_sections(_markdown())
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("k", "s")).select("doc_id", "k", F.col("s.title").alias("title"), F.md5("s.content").alias("content_md5"))


def t4_blank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.blank_line_chunks(F.replace("text", F.lit(". "), F.lit("\n\n")), ChatConfig.py_chunk_min_lines, ChatConfig.py_chunk_max)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("k", "chunk")).select("doc_id", "k", F.md5("chunk").alias("chunk_md5"))


def p0_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = builders.chat(F.col("question"), F.col("answer"), "Be brief.")
    return _exchanges(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")).alias("messages_md5"))


def p3_section_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = builders.md_section(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("text"))
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(qa).alias("k", "r"))
    return each.select("doc_id", "k", F.md5(F.col("r.messages")[1]["content"]).alias("user_md5"), F.md5(F.col("r.messages")[2]["content"]).alias("assistant_md5"))


def _code() -> Column:
    """Documents hold no code: some of their words become marks of it."""
    out = F.col("text")
    for word, mark in ((" the ", " raise "), (" and ", " logging."), (" de ", " ValueError "), (" of ", " .info("), (" der ", " assert ")):
        out = F.replace(out, F.lit(word), F.lit(mark))
    return out


def _said(found: Column) -> list[Column]:
    return [F.size(found).alias("n"), F.md5(F.array_join(found, "\n")).alias("lines_md5")]


def p5_validation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_said(builders.validation_lines(_code())))


def p6_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.replace(F.replace("text", F.lit("\nThe "), F.lit("\n  except ")), F.lit("\nOf "), F.lit("\ntry: "))
    return _docs(spark, sf_dir).select("doc_id", *_said(builders.error_lines(code)))


def p7_constant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.upper(F.translate("text", " ß", "="))
    return _docs(spark, sf_dir).select("doc_id", *_said(builders.constant_lines(code)))


def p8_logging_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_said(builders.logging_lines(_code())))


def f1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return messages.select("conv_id", filters.message_tokens(F.col("m")).alias("tokens"), filters.token_budget(F.col("m")).alias("kept"), filters.within_budget(F.col("m"), 400).alias("within"))


def f6_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", filters.is_boilerplate(F.col("text")).alias("boilerplate"))


def f5_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "markdown_section").otherwise("other")
    return _docs(spark, sf_dir).select("doc_id", filters.is_meaningful(kind, F.col("text")).alias("kept"))


def f9_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = filters.redacted(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), {"[0-9]{3,}": "#"})
    return _docs(spark, sf_dir).select("doc_id", F.md5(clean[0]["content"]).alias("clean_md5"))


def w1_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter(text.approx_tokens(F.col("text")).between(48, 4096))
    return filters.file_cap(rows, "source", ["doc_id"]).select("source", "doc_id")


def a1_dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("messages", F.array(builders.message("user", F.col("text"))))
    return dedupe.dedupe_records(rows, ["doc_id"]).select("doc_id")


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's turn right after it."""
    said = table(spark, sf_dir, "conversations")
    user, assistant = said.filter("role = 'user'"), said.filter("role = 'assistant'")
    after = assistant.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.select("conv_id", "turn", F.col("text").alias("question")).join(after, ["conv_id", "turn"])


def a2_dedupe_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exchanges(spark, sf_dir)
    return dedupe.dedupe_answers(rows, "question", "answer", ["conv_id", "turn"]).select("conv_id", "turn", dedupe.answer_key(F.col("question"), F.col("answer")).alias("answer_key"))


def a6_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").withColumn("unit", vectors.normalised(F.col("embedding")))
    found = vectors.centroids(unit, "label", "unit")
    return found.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"of": (" of ",), "the": ("the ", "thea"), "de": (" de ",), "die": ("die ", "DER ")}
    return _docs(spark, sf_dir).withColumn("tags", tags.tags(F.col("text"), None, words))


def v1_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("tags", ",").alias("tags"))


def a7_tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.tag_union(_tagged(spark, sf_dir), "source").select("source", F.array_join("ontology_tags", ",").alias("tags"))


def u3_tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(tags.merged(F.array(F.lit("of"), F.lit("old")), F.col("tags")), ",").alias("tags"))


def v2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def v3_hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hdbscan(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", ["vec_id"]).select("vec_id", F.col("label").alias("cluster"))


def v4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id")).alias("pos"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("long").alias("label"), vectors.normalised(F.col("embedding")).alias("unit"),
        F.array(F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string"))).alias("tags"), F.concat(F.lit("f"), (F.col("vec_id") % 7).cast("string")).alias("source_path"),
    )
    found = cluster.assemble(rows)
    return found.select("cluster_id", F.col("n").cast("int").alias("n"), F.array_join("ontology_tags", ",").alias("tags"), F.array_join("source_files", ",").alias("files"), F.round(F.col("centroid")[0], 6).alias("x0"))


def a9_spans_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("source_path"), "doc_id", F.col("lang").alias("kind"))
    return cluster.spans_by_file(rows, ["doc_id"]).select("source_path", "seq", "doc_id")


def o5_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = split.train_valid(_docs(spark, sf_dir).select("doc_id"), "doc_id")
    return split.numbered(parted, ["rank", "doc_id"], once=True).select("doc_id", "split", "position")


def o5_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_valid_exact(_docs(spark, sf_dir).select("doc_id"), ["doc_id"]).select("doc_id", "split", "position")


def o6_split_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.prefix(_docs(spark, sf_dir).select("doc_id"), ["doc_id"]).select("doc_id", "split")


def o7_split_905(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_valid_test(_docs(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "split")


def k2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.counts(split.train_valid_test(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id"), "source")


def p14_question_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = split.numbered(_docs(spark, sf_dir).select("doc_id", "source"), ["doc_id"], "idx")
    kind, asked = formats.question(F.col("idx"), F.concat(F.col("source"), F.lit(".f")), "corpus")
    return placed.select("doc_id", kind.alias("question_type"), asked.alias("question"))


def p13_span_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/a.b.md"))
    found = formats.span_context(path, F.lit("markdown_section"), F.lit(1), F.col("n_chars"), F.array("lang"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", formats.span_name(F.lit(""), path).alias("name"), F.md5(found).alias("context_md5"))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exchanges(spark, sf_dir).withColumn("chosen", F.col("answer"))
    placed = split.numbered(rows, ["conv_id", "turn"], "idx").withColumns({
        "rejected": F.when(F.col("idx") % 2 == 0, F.lit("")).otherwise(F.lit("no")), "kind": F.lit("function_definition"), "content": F.col("question"),
        "source_path": F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".py")), "tags": F.array().cast("array<string>"), "question_type": F.lit("explain"),
        "line_start": F.lit(1), "line_end": F.lit(2),
    })
    return formats.with_status(placed, ["idx"])


def a4_answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def p15_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.sft(_answered(spark, sf_dir).filter("status = 'kept'"), formats.system_prompt("corpus"))
    return rows.select("idx", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")).alias("messages_md5"), F.col("metadata.source_file").alias("source_file"), F.col("metadata.lines").alias("lines"))


def p15_dpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.dpo(_answered(spark, sf_dir).filter("status = 'kept'")).select("idx", "prompt", "chosen", "rejected")


def p15_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.grpo(_answered(spark, sf_dir).filter("status = 'kept'")).select("idx", "prompt", "reference")


def u1_union_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.build_records(_sources(spark, sf_dir)).groupBy(F.col("meta.task").alias("task")).agg(F.count(F.lit(1)).alias("n"))


def u4_cache_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("key"))
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key")).distinct()
    hits, missing = cache_split(docs, cache)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(missing.select("doc_id", F.lit(False).alias("hit")))


def v6_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cache_key(F.col("text"), "m").alias("key"))


def c1_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, "+-*/")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    r = arithmetic.computed(F.col("l_extendedprice"), op, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(r["value"], 4).alias("value"), r["error"].alias("error"), F.round(arithmetic.percentage(F.col("l_tax")), 6).alias("tax"), arithmetic.symbol(op).alias("symbol"))


def c3_number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", arithmetic.shown(F.col("p_retailprice")).alias("shown"), arithmetic.shown(F.col("p_size").cast("double")).alias("size"))


def c5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits, points, operators, backspace, sign and reset, by turns."""
    typed = F.element_at(F.array(*map(F.lit, ("+2*3=", "/4=", "5<~-.5=", "/0=", "C9%"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    keys = F.filter(F.split(F.concat(F.col("p_size").cast("string"), typed), ""), lambda k: k != "")
    return table(spark, sf_dir, "part").select("p_partkey", arithmetic.display(keys).alias("display"))


def _plain(kept: str = "A-Za-z0-9 .,") -> Column:
    """Whole texts that may stand in any source: other characters are blanks."""
    return F.regexp_replace("text", f"[^{kept}]", " ")


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    code = F.concat(
        F.lit('"""'), _plain(), F.lit(' about"""\n\n\ndef f'), i, F.lit('(x):\n    """'), "lang", F.lit('"""\n    return x\n\n\nclass C'), i,
        F.lit("(Base):\n    @property\n    def m(self):\n        return 1\n"),
    )
    return _docs(spark, sf_dir).select("doc_id", code.alias("text"))


def t1_py_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _python(spark, sf_dir).select("doc_id", F.posexplode(extract.with_python_items(F.col("text"))).alias("seq", "i"))
    return each.select("doc_id", "seq", "i.kind", "i.name", F.md5("i.docstring").alias("docstring_md5"), F.md5("i.code").alias("code_md5"))


def _script(i: Column) -> Column:
    return F.concat(F.lit("/**\n * "), _plain(), F.lit("\n */\nexport function f"), i, F.lit("(a, b) {\n  if (a) { return b; }\n}\nlet x = 1;\n"))


def t2_js_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = extract.with_js_items(_script(F.col("doc_id").cast("string")))
    each = _docs(spark, sf_dir).select("doc_id", F.posexplode(items).alias("seq", "i"))
    return each.select("doc_id", "seq", "i.kind", "i.name", F.md5("i.jsdoc").alias("jsdoc_md5"), F.md5("i.code").alias("code_md5"))


def _spans(files: DataFrame) -> DataFrame:
    found = spans.spans_of(files).withColumn("tags", F.array_join("tags", ","))
    return found.select("source_path", "seq", "kind", "line_start", "line_end", F.coalesce("name", "title").alias("named"), "tags", F.md5("content").alias("content_md5"))


def t6_py_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    code = F.concat(
        F.lit('"""'), "lang", F.lit(' notes"""\nimport os\n\ndef f'), i, F.lit('(x):\n    y = "'), _plain(), F.lit('"\n\n    return y\n\nclass K(Base):\n    def g(self):\n        return 1\n'),
    )
    return _spans(_docs(spark, sf_dir).select(F.concat(F.lit("d/f"), i, F.lit(".py")).alias("path"), F.lit(".py").alias("suffix"), code.alias("text")))


def t10_md_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.replace(_plain("A-Za-z0-9 .,\n"), F.lit(".\n"), F.lit(".\n## "))
    return _spans(_docs(spark, sf_dir).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(".md").alias("suffix"), said.alias("text")))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of each kind by turns, whole texts in their documentation."""
    i = F.col("doc_id").cast("string")
    py = F.concat(
        F.lit("import logging\n\n\ndef f"), i, F.lit('(x):\n    """'), _plain(),
        F.lit('"""\n    assert x\n    try:\n        logging.info(x)\n    except E:\n        b = 1\n\n    return b\n\n\nMAX_'), i, F.lit(" = 1\n"),
    )
    md = F.concat(F.lit("# T"), i, F.lit("\n"), _plain())
    turn = F.col("doc_id") % 3
    suffix = F.when(turn == 0, ".py").when(turn == 1, ".js").otherwise(".md")
    return _docs(spark, sf_dir).select(F.concat(F.lit("d/"), i, suffix).alias("path"), suffix.alias("suffix"), F.when(turn == 0, py).when(turn == 1, _script(i)).otherwise(md).alias("text"))


def p9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.build_records(_sources(spark, sf_dir))
    return rows.select(*chat.ORDER, "meta.task", F.md5(F.col("messages")[1]["content"]).alias("user_md5"), F.md5(F.col("messages")[2]["content"]).alias("assistant_md5"))


def p10_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record says of where it comes from."""
    rows = chat.build_records(_sources(spark, sf_dir), repo_path="/src", sha="c0ffee")
    return rows.select("path", "item_seq", "builder_seq", "sub_seq", F.col("meta.repo_path"), F.col("meta.path").alias("meta_path"), "meta.sha", "meta.task", "meta.source_type", "meta.title", "meta.name")


def v1_default_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("text")
    for word, mark in ((" the ", " FACTOR "), (" and ", " solver "), (" de ", " regime "), (" of ", " chart "), (" der ", " raise "), (" die ", " info(")):
        said = F.replace(said, F.lit(word), F.lit(mark))
    kind = F.when(F.col("doc_id") % 3 == 0, "logging_call").when(F.col("doc_id") % 3 == 1, "module_constant").otherwise("markdown_section")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tags.tags(said, kind), ",").alias("tags"))


def n15_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content")), F.struct(F.lit(None).cast("string").alias("content"))).alias("turns")))
    found = tolerant_json.turns(tolerant_json.parse(F.concat(F.lit("Sure: "), body, F.lit(" Done."))))
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(found).alias("k", "t"))
    return each.select("conv_id", "turn", "k", "t.role", F.md5("t.content").alias("content_md5"), F.size("t.evidence").alias("n_evidence"), F.size("t.metadata").alias("n_metadata"))


def k1_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written as JSON lines, then read as one dataset."""
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    folder = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    sinks.write_splits(split.train_valid(rows, "key"), folder, "turns.", order=("rank", "key"))
    files = [f"{folder}/turns.{name}.jsonl" for name in ("train", "valid")]
    return sinks.read_jsonl(spark, files, "conv_id long, turn long, role string, text string, key string").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "key")


def q1_filtered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files of one plan, from text to deduplicated records."""
    files = _docs(spark, sf_dir).select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.lit(".md").alias("suffix"), _markdown().alias("text"))
    rows = chat.filtered_records(files, ChatConfig(md_max_windows=windows.MOST_WINDOWS))
    return rows.select("path", "item_seq", "sub_seq", "meta.title", filters.message_tokens(F.col("messages")).alias("tokens"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        flagship, n1_token_count, n2_lines, n3_strip, n4_words, n6_case, n9_slices, n14_tolerant_json, n15_json_defaults, n16_paths, n17_repository_name,
        t1_py_items, t2_js_items, t3_md_sections, t4_blank_chunks, t5_word_windows, t6_py_spans, t10_md_spans,
        p0_chat_messages, p3_section_qa, p5_validation_lines, p6_error_lines, p7_constant_lines, p8_logging_lines, p9_records, p10_meta, p13_span_context,
        p14_question_rotation, p15_sft, p15_dpo, p15_grpo, f1_token_budget, f5_meaningful, f6_boilerplate, f9_redaction, w1_file_cap,
        a1_dedupe_exact, a2_dedupe_md5, a4_answer_status, a6_centroid, a7_tag_union, a9_spans_by_file, u1_union_builders, u3_tag_merge, u4_cache_anti,
        v1_tags, v1_default_tags, v2_normalize, v3_hdbscan, v4_clusters, v6_cache_key, o5_split_hash, o5_split_exact, o6_split_prefix, o7_split_905, k1_jsonl, k2_stats,
        q1_filtered_records, c1_calc, c3_number_format, c5_keys,
    )
} | table_queries.QUERIES | model_queries.QUERIES
