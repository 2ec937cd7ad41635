"""Records, splits, clusters and whole plans."""

import json
import random
from pathlib import Path

import held
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import queries, sql
from millrace.config import ChatConfig, ClusterConfig
from millrace.operators import builders, cluster, dedupe, filters, formats, split, synthesis, tags
from millrace.plans import chat, extractors, jobs, spans
from millrace.sources import cache, repository, sinks
from millrace.storage import shared_dir
from millrace.streaming import records as stream


#: A small tree of sources.
FILES = [
    ("pkg/a.py", '"""About a."""\nimport logging\n\nMAX_ROWS = 10\n\n\ndef load(path):\n    """Load a file."""\n    assert path\n\n    try:\n        rows = open(path).read()\n    except OSError:\n        logging.error("no file")\n        raise ValueError(path)\n\n    count = len(rows)\n    logging.info("read %s", count)\n\n    return rows\n' + "\n".join(f"# note {i}" for i in range(3)) + "\n"),
    ("pkg/b.py", "class Tool:\n" + "".join(f"    def step_{i}(self, value):\n        # step {i} of the work on a value that is passed along\n        return value + {i}\n\n" for i in range(8))),
    ("web/c.js", "/**\n * Multiply two numbers.\n */\nexport function mul(a, b) {\n  return a * b;\n}\n"),
    ("README.md", "\n# Title\n\nIntro\n\n## Details\n\nMore info\n\n### Deep\n\nText `code`.\n\n```\n# no heading\n```\n\n## Last\n\nEnd.\n"),
    ("bad.py", "def broken(:\nMAX = 1\n"),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_section_questions(spark):
    content = "This section explains usage. Inputs: A,B. Outputs: C. Limitations: none."
    found = one(spark, builders.md_section(F.col("t"), F.col("c"), 3, 50), t="Usage", c=content)
    assert 1 <= len(found) <= 3 and all(content in r.messages[1].content and r.title == "Usage" for r in found)
    assert len(one(spark, builders.md_section(F.col("t"), F.col("c"), 0), t=" ", c=content)) == 1
    assert len(one(spark, builders.md_section(F.col("t"), F.col("c"), -1), t=" ", c=content)) == 3
    assert one(spark, builders.md_section(F.col("t"), F.col("c")), t="x", c="  ") == []


def test_summaries(spark):
    code = "_X = 1\nX: int = 1\nX == 1\n  N=5,\nA B = 2\nMAX_ROWS = 3\n"
    assert one(spark, builders.constant_lines(F.col("c")), c=code) == ["X == 1", "N=5,", "MAX_ROWS = 3"]
    assert one(spark, builders.error_lines(F.col("c")), c="  try:\n  x()\n  except:\n  pass") == ["  try:"]
    assert one(spark, builders.py_errors(F.col("c")), c="x = 1") is None
    assert one(spark, builders.py_chunk(F.col("n"), F.col("c")), n="f", c="  ") is None
    record = one(spark, builders.py_chunk(F.lit(None).cast("string"), F.col("c")), c="x")
    assert "chunk from None." in record.messages[1].content


@pytest.mark.parametrize("total, kept", [(47, False), (48, True), (4096, True), (4097, False)])
def test_budget(spark, total, kept):
    rows = spark.createDataFrame([([("user", "x" * 4 * (total - 1)), ("assistant", "")],)], builders.MESSAGES.join(["m ", ""]))
    assert rows.select(filters.token_budget(F.col("m")).alias("k")).first().k is kept


def test_cap_then_dedupe(spark):
    rows = [("p", i, "same" if i < 15 else "other") for i in range(16)]
    frame = spark.createDataFrame(rows, "path string, seq int, said string").withColumn("messages", F.array(builders.message("user", F.col("said"))))
    kept = dedupe.dedupe_records(filters.file_cap(frame, "path", ["seq"]), ["seq"])
    assert [(r.seq, r.said) for r in kept.collect()] == [(0, "same")]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 19, 20, 57])
def test_splits(spark, n):
    rows = spark.range(n).select(F.col("id"))
    found = split.train_valid(rows, "id")
    ranked = sorted((r["rank"], r["split"]) for r in found.collect())
    assert [s for _, s in ranked] == ["valid"] * split.n_valid(n) + ["train"] * (n - split.n_valid(n))
    assert sorted(r.position for r in split.numbered(found, ["rank"]).collect()) == list(range(n))
    assert found.filter("split = 'valid'").count() == (max(1, int(n * 0.1)) if n else 0)
    assert split.prefix(rows, ["id"]).filter("split = 'valid'").count() == int(n * 0.1)
    three = {r["split"]: r["count"] for r in split.train_valid_test(rows, "id").groupBy("split").count().collect()}
    assert (three.get("train", 0), three.get("valid", 0)) == (int(n * 0.9), int(n * 0.95) - int(n * 0.9))


@pytest.mark.parametrize(
    "cut",
    [
        lambda r: split.train_valid(r, "id"), lambda r: split.train_valid_test(r, "id"), lambda r: split.prefix(r, ["id"]), lambda r: split.train_valid_exact(r, ["id"]),
        lambda r: split.numbered(r, ["id"]),
    ],
)
def test_splits_work_out_their_input_once(spark, cut):
    tasks = spark.sparkContext.accumulator(0)

    def seen(batches):
        tasks.add(1)
        yield from batches

    rows = cut(spark.range(100).repartition(3).mapInArrow(seen, "id long"))
    assert rows.count() == 100 and rows.orderBy("id").count() == 100 and tasks.value == 3


def test_ends_within_large_groups(spark, monkeypatch):
    monkeypatch.setattr(split, "_FEW", 2)
    monkeypatch.setattr(split, "hash_rank", lambda seed, key: F.concat(F.lit("ab" * 8), F.substring(F.md5(key.cast("string")), 1, 16)))
    found = split.train_valid(spark.range(500), "id")
    order = sorted((r["rank"], r["split"]) for r in found.collect())
    assert [s for _, s in order] == ["valid"] * 50 + ["train"] * 450


def test_exact_split(spark):
    found = split.train_valid_exact(spark.range(10).select("id"), ["id"]).orderBy("position").collect()
    assert [r.id for r in found] == [7, 3, 0, 5, 1, 9, 2, 4, 6, 8] and [r["split"] for r in found][:2] == ["valid", "train"]


def test_tags(spark):
    assert one(spark, tags.tags(F.col("c"), F.col("k")), c="RAISE ValueError", k="module_constant") == ["config", "validation"]
    assert one(spark, tags.merged(F.array(F.lit("z")), tags.tags(F.col("c"))), c="a chart and a target") == ["z", "optimizer", "report"]


def test_boilerplate(spark):
    for said, bad in (("x" * 149, True), ("x" * 150, False), ("CODE ANALYSIS" + "x" * 150, True)):
        assert one(spark, filters.is_boilerplate(F.col("a")), a=said) is bad


def test_questions(spark):
    rows = spark.range(8).select("id", formats.question(F.col("id"), F.lit("n"), "r")[0].alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == [t for t, _ in formats.QUESTIONS] + ["explain", "domain"]


def points(seed=0):
    rnd = np.random.default_rng(seed)
    groups = [rnd.normal(c, 0.02, (12, 3)) for c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    return np.concatenate([*groups, [[-1, -1, -1], [-1, -1, -0.8]]])


def test_hdbscan_finds_groups(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(points())]
    found = cluster.hdbscan(spark.createDataFrame(rows, "id long, v array<double>"), "v", ["id"], ClusterConfig()).orderBy("id").collect()
    labels = [r.label for r in found]
    assert [len(set(labels[k : k + 12])) for k in (0, 12, 24)] == [1, 1, 1] and len(set(labels[:36])) == 3 and labels[36:] == [-1, -1]


@pytest.mark.parametrize("few", [8, 0])
def test_spanning_tree_by_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 10)
    monkeypatch.setattr(cluster, "FEW_BLOCKS", few)
    x = points(1)
    tree = cluster.spanning_tree(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>"), 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 2]
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, total = [0], 0.0  # Prim's algorithm
    while len(inside) < len(x):
        rest = [j for j in range(len(x)) if j not in inside]
        w, j = min((m[i, j], j) for i in inside for j in rest)
        total, inside = total + w, [*inside, j]
    assert len(tree) == len(x) - 1 and sum(w for _, _, w in tree) == pytest.approx(total)


def test_far_blocks_never_meet(spark, monkeypatch):
    """The tree and the clusters are those of all pairs, though most pairs of blocks don't meet; many points coincide."""
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(0, 0.05, (40, 6)) + rnd.normal(0, 3, 6) for _ in range(12)] + [np.zeros((9, 6))])
    x = x[rnd.permutation(len(x))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>")
    whole = cluster.spanning_tree(rows, 3)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 20)
    counts = []
    tree = cluster.spanning_tree(rows, 3, counts)
    blocks = -(-len(x) // 20)  # at least, as no block holds points of two pivots
    assert sorted(round(w, 6) for *_, w in tree) == sorted(round(w, 6) for *_, w in whole)
    assert cluster.tree_labels(len(x), tree, 5) == cluster.tree_labels(len(x), whole, 5)
    assert max(counts) < blocks**2 / 2 and sum(counts) < len(counts) * blocks**2 / 4


def test_overlapping_blocks_meet_once(spark, monkeypatch):
    """No block of one cloud can be left out, yet all pairs of blocks meet about once, not once for each round."""
    x = np.random.default_rng(5).normal(0, 1, (400, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>")
    whole = cluster.spanning_tree(rows, 3)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cluster, "FEW_BLOCKS", 0)
    counts = []
    tree = cluster.spanning_tree(rows, 3, counts)
    assert sorted(round(w, 6) for *_, w in tree) == sorted(round(w, 6) for *_, w in whole)
    assert cluster.tree_labels(len(x), tree, 5) == cluster.tree_labels(len(x), whole, 5)
    blocks = len(cluster._balls(rows, 10).radius)
    assert sum(counts) < 2 * blocks**2


def test_no_number_no_tree(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 10)
    monkeypatch.setattr(cluster, "FEW_BLOCKS", 0)
    rows = [(i, v.tolist()) for i, v in enumerate(points(1))] + [(38, [float("nan")] * 3)]
    with pytest.raises(ValueError):
        cluster.spanning_tree(spark.createDataFrame(rows, "pos long, v array<double>"), 3)


def test_small_clusterings(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert cluster.hdbscan(empty, "v", ["id"]).count() == 0
    assert [r.label for r in cluster.hdbscan(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "v", ["id"]).collect()] == [-1]


@pytest.fixture()
def tree(tmp_path):
    for path, said in FILES:
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(said.encode() + (b"\xff" if path == "README.md" else b""))
    skipped = tmp_path / "tree" / "node_modules" / "x.md"
    skipped.parent.mkdir()
    skipped.write_text("# Dep\n" + "text " * 80)
    (tmp_path / "tree" / "no.txt").write_text("no")
    return str(tmp_path / "tree")


def lines(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_files(spark, tree):
    every = {r.path: r.text for r in repository.chat_files(spark, tree).collect()}
    assert set(every) == {"pkg/a.py", "pkg/b.py", "web/c.js", "README.md", "bad.py", "node_modules/x.md"} and "\ufffd" not in every["README.md"]
    assert "node_modules/x.md" not in {r.path for r in repository.chat_files(spark, tree, prune_excluded=True).collect()}
    assert {r.suffix for r in repository.span_files(spark, tree).collect()} == {".py", ".md"}


def test_chat_plan(spark, tree, tmp_path):
    seen = []
    out = tmp_path / "out"
    got = chat.generate(spark, tree, str(out), ChatConfig(min_tokens=1), "abc", exact_split=True, progress=lambda m, p: seen.append(p))
    train, valid = lines(out / "dataset.train.jsonl"), lines(out / "dataset.valid.jsonl")
    assert got == {"sha": "abc", "counts": {"total": len(train) + len(valid), "train": len(train), "valid": len(valid)}}
    assert json.loads((out / "stats.json").read_text()) == got["counts"] and len(valid) == max(1, int((len(train) + len(valid)) * 0.1)) and seen == [20, 60, 70, 90, 100]
    tasks = {r["meta"]["task"] for r in train + valid}
    assert {"py_docstring_from_code", "py_chunk_explain", "py_validation_summary", "py_error_handling_summary", "py_logging_flow_summary", "py_config_constants_summary", "js_jsdoc_from_code", "md_section_qa"} <= tasks
    assert any(r["meta"]["path"] == "bad.py" for r in train + valid)  # it doesn't parse, but has constants


def test_command_line(spark, tree, tmp_path, monkeypatch, capsys):
    """Options as they are given, else as the environment or a file sets them; one of a tree and an address has to be named."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("# own\nexport MILLRACE_MIN_TOKENS='1'\nMILLRACE_PY_CHUNKING=no\nMILLRACE_FILE_CAP=9\n")
    monkeypatch.setenv("MILLRACE_FILE_CAP", "50")
    chat.main(["--root", tree, "--out", str(tmp_path / "out"), "--no-include-errors", "--valid-ratio", "0.5"])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    train, valid = lines(tmp_path / "out" / "dataset.train.jsonl"), lines(tmp_path / "out" / "dataset.valid.jsonl")
    assert said["counts"] == {"total": len(train) + len(valid), "train": len(train), "valid": len(valid)} and len(valid) == (len(train) + len(valid)) // 2
    config = ChatConfig(min_tokens=1, py_chunking=False, file_cap=50, include_errors=False)
    assert said["counts"]["total"] == chat.filtered_records(repository.chat_files(spark, tree), config).count()
    for wrong in (["--out", "x"], ["--root", "a", "--repo", "b", "--out", "x"]):
        with pytest.raises(SystemExit):
            chat.main(wrong)


def test_settings():
    assert ChatConfig.from_environment({}) == ChatConfig()
    assert ChatConfig.from_environment({"MILLRACE_VALID_RATIO": "0.2", "MILLRACE_SEED": "", "MILLRACE_ALLOW_LLM": "On"}) == ChatConfig(valid_ratio=0.2, allow_llm=True)
    with pytest.raises(ValueError):
        ChatConfig.from_environment({"MILLRACE_ALLOW_LLM": "perhaps"})


def test_flags_leave_builders_out(spark, tree):
    config = ChatConfig(min_tokens=1, py_chunking=False, include_validation=False, include_errors=False, include_config=False, include_logging=False)
    tasks = {r.task for r in chat.build_records(repository.chat_files(spark, tree), config).select("meta.task").distinct().collect()}
    assert tasks == {"py_docstring_from_code", "js_jsdoc_from_code", "md_section_qa"}


def test_own_extractor(spark, monkeypatch):
    monkeypatch.setattr(extractors, "_registered", {})
    extractors.register_extractor((".ini",), lambda t: [{"messages": [{"role": "user", "content": t}], "task": "ini", "source_type": "ini"}])
    files = spark.createDataFrame([("a.ini", ".ini", "x=1"), ("b.md", ".md", "# T\nsaid")], "path string, suffix string, text string")
    assert {r.task for r in chat.build_records(files).select("meta.task").collect()} == {"ini", "md_section_qa"}


def embed(texts):
    return np.array([[len(t) % 7, t.count("e"), 1.0] for t in texts])


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa")], "id int, content string")
    path = str(tmp_path / "cache")
    first = cache.embedded(rows, "content", embed, "m", path).count()
    again = cache.embedded(rows, "content", lambda t: (_ for _ in ()).throw(RuntimeError("asked again")), "m", path)
    assert first == again.count() == 3 and spark.read.parquet(path).count() == 2


def test_conversations(spark, tree, tmp_path):
    def writer(system, prompt, tokens, heat):
        if "broken" in prompt:
            raise RuntimeError("no")
        return 'Here: {"turns": [{"role": "user", "content": "q"}], "summary": {"bullet_points": "b"}}'

    out = tmp_path / "talk"
    stats = spans.conversations(spark, tree, str(out), embed, writer, lambda *a: "OK")
    rows = lines(out / "semantic.train.jsonl") + lines(out / "semantic.valid.jsonl")
    assert stats["total"] == len(rows) > 0 and all(r["critique"] == "OK" and r["turns"][0]["content"] == "q" and r["source_files"] for r in rows)


def test_record_formats(spark, tree, tmp_path):
    def model(system, prompt, tokens, heat):
        return None if tokens == 200 else "A precise answer about `step_1`. " * 6 + prompt[-20:]

    out = tmp_path / "formats"
    stats = spans.record_formats(spark, tree, str(out), model, "n")
    assert stats["sft"]["total"] == stats["success"] >= 1 and stats["sft"] == stats["dpo"]
    dpo = [r for s in ("train", "valid", "test") for r in lines(out / f"n_dpo_{s}.jsonl")]
    assert dpo and all(r["rejected"].startswith("This code handles various operations related to ") for r in dpo)


def test_failed_calls_are_rows(spark):
    def model(system, prompt, tokens, heat):
        raise RuntimeError("busy")

    got = synthesis.asked(spark.createDataFrame([("p",), (None,)], "prompt string"), "", "prompt", "said", model, 1, 0.0).collect()
    assert sorted((r.said, r.error) for r in got if r.prompt) == [(None, "RuntimeError: busy")] and [r.error for r in got if not r.prompt] == [None]


def test_jobs(spark, tree, tmp_path):
    import time

    held = jobs.Jobs(spark, str(tmp_path))
    with pytest.raises(ValueError):
        held.create(tree, "/elsewhere")
    job = held.create(tree, str(tmp_path / "j"), {"min_tokens": 1})
    bad = held.create(str(tmp_path / "missing"), str(tmp_path / "k"))
    end = time.time() + 180
    while time.time() < end and {held.get(job).state, held.get(bad).state} & {"queued", "running"}:
        time.sleep(0.5)
    assert held.get(job).state == "done" and held.result(job)["counts"]["total"] > 0 and held.get(bad).state == "error" and len(held.list()) == 2
    with pytest.raises(ValueError):
        held.result(bad)
    assert jobs.is_inside(str(tmp_path / "a"), str(tmp_path)) and not jobs.is_inside(str(tmp_path / ".." / "a"), str(tmp_path))


def test_clone(tmp_path):
    import subprocess

    origin = tmp_path / "origin"
    for command in (["init", "-q", str(origin)], ["-C", str(origin), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", *command], check=True)
    _, sha = repository.shallow_clone(f"file://{origin}", str(tmp_path / "clone"))
    assert len(sha) == 40
    with pytest.raises(RuntimeError, match="git clone failed"):
        repository.shallow_clone(str(tmp_path / "nowhere"), str(tmp_path / "c2"))


def test_stream(spark, tmp_path):
    files = [{"path": f"{i}.md", "suffix": ".md", "text": "# T\n" + f"words {i % 3} " * 60} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, files)))
    for _ in range(2):  # the second run finds nothing new
        stream.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = sinks.read_jsonl(spark, [str(tmp_path / "out" / "batch=0")])
    assert rows.count() == 3 * 4


def test_random_module_is_the_standard():
    order = list(range(10))
    random.Random(17).shuffle(order)
    assert order[0] == 7


def resident(*_):
    return str(int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20)


def test_models_see_prompts_alone(spark):
    rows = spark.range(4000, numPartitions=1).select(F.lit("p").alias("prompt"), F.repeat(F.lit("x"), 100_000).alias("content"))
    said = synthesis.asked(rows, "", "prompt", "said", resident, 1, 0.0)
    found = said.agg(F.max(F.col("said").cast("int")).alias("mb"), F.sum(F.length("content")).alias("n")).first()
    assert found.n == 400_000_000 and found.mb < 250


def test_records_are_worked_out_once(spark):
    """Files aren't filtered by the size of their records first, which would parse them twice."""
    files = spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], t) for p, t in FILES], "path string, suffix string, text string")
    rows = chat.build_records(files)
    assert rows._jdf.queryExecution().executedPlan().toString().count("EvalPython [") == 1
    assert rows.filter("messages is null").count() == 0 < rows.filter("path = 'pkg/a.py'").count()
    assert rows.filter("path = 'bad.py'").select("meta.task").collect() == [("py_config_constants_summary",)]


@pytest.mark.parametrize("name", ["p9_records", "p10_meta", "u1_union_builders"])
def test_windows_of_a_whole_text_have_records(spark, tmp_path, monkeypatch, name):
    words = 30_000
    rows = [(2, " ".join(f"w{i}" for i in range(words)), "en"), (5, "short", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas().to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(held, "SF_DIR", str(tmp_path))
    assert not held.differences(spark, queries.QUERIES[name], sql.ORACLES[name])
    found = queries.QUERIES[name](spark, str(tmp_path))
    windows = found.filter("task = 'md_section_qa'").first().n if name == "u1_union_builders" else found.filter("path = 'd/2.md'").count() + 4
    assert windows == 4 * (-(-words // 680) + 1)


def test_contents_of_spans_are_kept_once(spark, tmp_path):
    """Answers are kept without contents, numbered rows are shuffled and kept once, and the records are those of a run without a folder to resume from."""
    from millrace.model_queries import answerer

    rows = [(f"d/{i:03}.md", 0, "markdown_section", f"text {i} " * 60, 1, 2, f"n{i}", None, ["doc"], "x" * 50) for i in range(60)]
    given = spark.createDataFrame(rows, "source_path string, seq int, kind string, content string, line_start int, line_end int, name string, title string, tags array<string>, other string")
    stats = [spans.formats_of(given, "r", f"{tmp_path}/{out}", answerer, "n", None, resume=folder) for out, folder in (("a", f"{tmp_path}/raw"), ("b", None))]
    assert stats[0] == stats[1] and stats[0]["grpo"]["total"] > 30
    assert not {"content", "context"} & set(spark.read.parquet(f"{tmp_path}/raw/answers").columns)
    assert "content" in (kept := spark.read.parquet(f"{tmp_path}/raw/work").columns) and not {"context", "other"} & set(kept)
    for kind in ("sft", "dpo", "grpo"):
        a, b = (sorted(map(str, spark.read.json([f"{tmp_path}/{out}/n_{kind}_{part}.jsonl" for part in ("train", "valid", "test")]).collect())) for out in ("a", "b"))
        assert a == b
    found = {r.reference for r in spark.read.json(f"{tmp_path}/a/n_grpo_train.jsonl").collect()}
    assert found <= {r[3] for r in rows} and len(found) > 20
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("millrace-*"))
    placed = split.numbered(given.repartition(3), ["source_path"], "at")
    assert len(set(folder.glob("millrace-*")) - before) == 1 and "Window [row_number" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert [r.source_path for r in placed.orderBy("at").collect()] == [r[0] for r in rows] and [r.at for r in placed.orderBy("at").collect()] == list(range(60))


def test_blocks_are_sent_once_for_each_group(spark, monkeypatch):
    """Every pair of blocks meets with its own vectors, though a block is not sent for each pair."""
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 8)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(800, 4))
    balls = cluster._balls(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>"), 100)
    n = len(balls.radius)
    pairs = np.argwhere(np.triu(np.ones((n, n), bool)))

    def seen(cell, mine, left, right):
        ok = all(np.array_equal(x[pos], v) for pos, v in (left | right).values()) and all(i in left and j in right for i, j in mine.tolist())
        return pa.table({"i": mine[:, 0], "j": mine[:, 1], "held": pa.array([len(left)] * len(mine), pa.int32()), "cell": pa.array([cell] * len(mine), pa.int64()), "ok": [ok] * len(mine)})

    found = balls.met(pairs, seen, "i int, j int, held int, cell long, ok boolean").collect()
    assert sorted((r.i, r.j) for r in found) == sorted(map(tuple, pairs.tolist())) and all(r.ok for r in found)
    groups = -(-n // balls.width(n))
    assert 1 < groups and sum({r.cell: r.held for r in found}.values()) <= n * groups < len(pairs) / 3
