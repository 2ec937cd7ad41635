"""Chat records of source files, as arrays of structs: one file, one row, no shuffle until records are deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChatConfig
from ..functions.text import contains_any, is_upper, let, lines, starts_alpha, strip
from .extract import with_js_items, with_python_items
from .sections import markdown_sections
from .windows import MOST_WINDOWS, blank_line_chunks, windowed

MESSAGES = "array<struct<role:string,content:string>>"
RECORD = f"struct<messages:{MESSAGES},task:string,source_type:string,title:string,name:string>"
RECORDS = f"array<{RECORD}>"

#: The texts of prompts.
PY_SYSTEM = "You are a helpful Python assistant."
JS_SYSTEM = "You are a helpful JavaScript assistant."
MD_SYSTEM = "You are a documentation assistant."
PRECISE_SYSTEM = "You are a precise Python assistant."
CONFIG_SYSTEM = "You are a configuration expert."
LOGGING_SYSTEM = "You are a logging expert."
PY_DOCSTRING = "Write a clear, concise docstring for the following Python code.\n\n"
JS_JSDOC = "Write a JSDoc comment for the following JavaScript/TypeScript function.\n\n"
PY_CHUNK = ("Explain the following Python code chunk from ", ". Focus on what it does and why.\n\n")
VALIDATION = "What inputs are validated and how? Summarize from the code (asserts and raises).\n\n"
ERRORS = "Explain the error handling in this code. Which exceptions are caught and what happens?\n\n"
CONFIG = "Summarize the configuration constants defined in this module.\n\n"
LOGGING = "Describe the logging flow: logger names, levels, and key messages.\n\n"
#: Before and after a section's title.
MD_QUESTIONS = (
    ("What is ", "? Provide a concise explanation based only on this section."),
    ("What are the key inputs and outputs described in ", "?"),
    ("Summarize any policies, caveats, or limitations mentioned in ", "."),
    ("Describe the workflow/steps outlined in ", "."),
)
#: What lines of interest hold.
VALIDATION_MARKS = ("assert ", "raise ", "ValueError", "TypeError", "KeyError")
LOGGING_MARKS = ("logging.", ".debug(", ".info(", ".warning(", ".error(", ".exception(")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, assistant: Column, system: str | None = None) -> Column:
    """Messages of one exchange; a system message only if there is something in it."""
    first = [message("system", F.lit(system))] if system else []
    return F.array(*first, message("user", user), message("assistant", assistant))


def record(messages: Column, task: str, source_type: str, title: Column | None = None, name: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        messages.cast(MESSAGES).alias("messages"), F.lit(task).alias("task"), F.lit(source_type).alias("source_type"),
        (none if title is None else title).alias("title"), (none if name is None else name).alias("name"),
    )


def py_docstring(docstring: Column, code: Column) -> Column:
    """Null without a docstring, as all builders that find nothing to say."""
    said = strip(docstring)
    return F.when(said != "", record(chat(F.concat(F.lit(PY_DOCSTRING), strip(code)), said, PY_SYSTEM), "py_docstring_from_code", "python"))


def js_jsdoc(jsdoc: Column, code: Column) -> Column:
    said = strip(jsdoc)
    return F.when(said != "", record(chat(F.concat(F.lit(JS_JSDOC), strip(code)), said, JS_SYSTEM), "js_jsdoc_from_code", "javascript"))


def md_section(title: Column, content: Column, max_questions: int = 4, window: int = 800, overlap: int = 120, most_windows: int | None = MOST_WINDOWS) -> Column:
    """An array: every question about every window of a section, or about the first `most_windows`."""
    templates, none = MD_QUESTIONS[: max_questions or 1], F.array().cast(RECORDS)

    def of(named: Column, said: Column) -> Column:
        def about(w: Column) -> Column:
            asked = [F.concat(F.lit(a), named, F.lit(b + "\n\n"), w) for a, b in templates]
            return F.array(*(record(chat(q, w, MD_SYSTEM), "md_section_qa", "markdown", title=named) for q in asked))

        return F.when(said != "", F.flatten(F.transform(windowed(said, window, overlap, most_windows), about))).otherwise(none)

    named = F.coalesce(F.nullif(strip(title), F.lit("")), F.lit("Section"))
    return let(named, lambda t: let(strip(content), lambda c: of(t, c))) if templates else none


def py_chunk(name: Column, chunk: Column) -> Column:
    """A module's name is None, and so it is written."""
    user = F.concat(F.lit(PY_CHUNK[0]), F.coalesce(name, F.lit("None")), F.lit(PY_CHUNK[1]), chunk)
    return F.when(strip(chunk) != "", record(chat(user, chunk, PY_SYSTEM), "py_chunk_explain", "python", name=name))


def _summary(lines_: Column, ask: str, system: str, task: str, about: Column | None = None) -> Column:
    """A record about the code, or about the lines themselves."""

    def of(found: Column) -> Column:
        said = F.array_join(found, "\n")
        return F.when(F.size(found) > 0, record(chat(F.concat(F.lit(ask), said if about is None else about), said, system), task, "python"))

    return let(lines_, of)


def validation_lines(code: Column) -> Column:
    return F.filter(lines(code), lambda x: contains_any(x, VALIDATION_MARKS))


def error_lines(code: Column) -> Column:
    return F.filter(lines(code), lambda x: strip(x).startswith("except ") | strip(x).startswith("try:"))


def logging_lines(code: Column) -> Column:
    return F.transform(F.filter(lines(code), lambda x: contains_any(x, LOGGING_MARKS)), strip)


def constant_lines(code: Column) -> Column:
    """Lines that look like constants: text in capitals, without spaces, before the first =."""

    def fits(line: Column) -> Column:
        left = strip(F.substring_index(line, "=", 1))
        return line.contains("=") & starts_alpha(strip(line)) & is_upper(left) & ~left.contains(" ")

    return F.transform(F.filter(lines(code), fits), strip)


def py_validation(code: Column) -> Column:
    return _summary(validation_lines(code), VALIDATION, PRECISE_SYSTEM, "py_validation_summary", code)


def py_errors(code: Column) -> Column:
    return _summary(error_lines(code), ERRORS, PRECISE_SYSTEM, "py_error_handling_summary", code)


def py_config(code: Column) -> Column:
    return _summary(constant_lines(code), CONFIG, CONFIG_SYSTEM, "py_config_constants_summary")


def py_logging(code: Column) -> Column:
    return _summary(logging_lines(code), LOGGING, LOGGING_SYSTEM, "py_logging_flow_summary")


def _keyed(records: Column, item: Column, builder: int) -> Column:
    """(item_seq, builder_seq, sub_seq, record) for an array of records, nulls left out."""
    each = F.transform(records, lambda r, i: F.struct(item.cast("int").alias("item_seq"), F.lit(builder).alias("builder_seq"), i.cast("int").alias("sub_seq"), r.cast(RECORD).alias("record")))
    return F.filter(each, lambda x: x["record"].isNotNull())


def python_records(items: Column, text: Column, config: ChatConfig) -> Column:
    """All records of a Python file in order; each flag off is a branch less in the plan."""

    def of(item: Column, i: Column) -> Column:
        code = item["code"]
        parts = [_keyed(F.array(py_docstring(item["docstring"], code)), i, 0)]
        if config.py_chunking:
            chunks = blank_line_chunks(code, config.py_chunk_min_lines, config.py_chunk_max)
            parts.append(_keyed(F.transform(chunks, lambda c: py_chunk(item["name"], c)), i, 1))
        for k, (wanted, build) in enumerate(((config.include_validation, py_validation), (config.include_errors, py_errors), (config.include_logging, py_logging)), 2):
            if wanted:
                parts.append(_keyed(F.array(F.when(code != "", build(code))), i, k))
        return F.concat(*parts)

    found = F.flatten(F.transform(items, of))
    if not config.include_config:
        return found
    return F.concat(found, _keyed(F.array(F.when(text != "", py_config(text))), F.size(items), 5))


def js_records(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x, i: _keyed(F.array(js_jsdoc(x["jsdoc"], x["code"])), i, 0)))


def markdown_records(sections: Column, config: ChatConfig) -> Column:
    return F.flatten(F.transform(sections, lambda s, i: _keyed(md_section(s["title"], s["content"], config.md_max_questions, config.md_window_tokens, config.md_overlap_tokens, config.md_max_windows or None), i, 0)))


def with_records(files: DataFrame, config: ChatConfig) -> DataFrame:
    """The files (path, suffix, text) with `records`, by their suffix; each text is parsed by its own language's parser only."""
    suffix, text = F.col("suffix"), F.col("text")
    py, js, md = suffix == ".py", suffix.isin(".js", ".jsx", ".ts", ".tsx"), F.lower(suffix) == ".md"
    parsed = files.withColumns({"__py": with_python_items(F.when(py, text)), "__js": with_js_items(F.when(js, text))})
    built = F.when(py, python_records(F.col("__py"), text, config)).when(js, js_records(F.col("__js"))).when(md, markdown_records(markdown_sections(text), config))
    return parsed.withColumn("records", built).drop("__py", "__js")
