"""The source tree as a data source."""

import os
from pathlib import PurePath

import pytest
from pyspark.sql import functions as F

from millrace.sources import repository, tree

FILES = {
    "pkg/__init__.py": b"a = 1\r\nb\r", "pkg/_util.py": b"\xffx\xc3\xa9", ".github/a.md": b"# A", "_docs/B.MD": b"", "c.py": b"x" * 50, "web/d.tsx": b"t", "e.txt": b"no", "noext": b"", ".py": b"hidden", "f.PY": b"upper", "g.tar.md": b"two",
}


@pytest.fixture()
def root(tmp_path):
    for path, said in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(said)
    return str(tmp_path)


def test_every_file_is_read(spark, root):
    got = {r.path: (r.suffix, r.size, r.text) for r in tree.source_tree(spark, root).collect()}
    assert set(got) == set(FILES)
    assert all(got[p] == (PurePath(p).suffix, len(b), b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")) for p, b in FILES.items())
    assert {r.path for r in repository.chat_files(spark, root).collect()} == {"pkg/__init__.py", "pkg/_util.py", ".github/a.md", "c.py", "web/d.tsx", "g.tar.md"}
    assert {r.path for r in repository.span_files(spark, f"file://{root}").collect()} == {"pkg/__init__.py", "pkg/_util.py", ".github/a.md", "_docs/B.MD", "c.py", "g.tar.md"}


def test_partitions_by_size(spark, root):
    rows = tree.source_tree(spark, root, partition_bytes=10)
    assert rows.rdd.getNumPartitions() > 3 and rows.count() == len(FILES)
    assert [p.paths for p in tree.dealt([("a", 5), ("b", 5), ("c", 20), ("d", 0)], 10)] == [("a", "b"), ("c",), ("d",)]


def test_pushed_suffixes(spark, root):
    """Files of other suffixes aren't opened: one that can't be read does no harm."""
    os.remove(f"{root}/e.txt")
    os.symlink(f"{root}/pkg", f"{root}/link")
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = tree.source_tree(spark, root).filter(F.col("suffix").isin(".md", ".tsx")).filter("size > 1")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        left = next(line for line in plan.splitlines() if " Filter " in line)
        assert "size" in left and "suffix" not in left  # what the source takes on is filtered no more
        assert {r.path for r in rows.collect()} == {".github/a.md", "g.tar.md"}
        pushed = tree.PushedReader(tree.Tree(root, 1000))
        from pyspark.sql.datasource import EqualTo, In

        left = list(pushed.pushFilters([In(("suffix",), (".py", ".md")), EqualTo(("path",), "c.py"), EqualTo(("suffix",), ".py")]))
        assert left == [EqualTo(("path",), "c.py")] and pushed.partitions()[0].paths == ("c.py", "pkg/__init__.py", "pkg/_util.py")
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_stream_of_changes(spark, root, tmp_path_factory):
    spark.dataSource.register(tree.SourceTree)
    at, out = tmp_path_factory.mktemp("at"), tmp_path_factory.mktemp("out")
    os.utime(f"{root}/c.py", ns=(1, 10**18))

    def run():
        rows = spark.readStream.format(tree.NAME).option("suffixes", ".py").load(root)
        rows.writeStream.format("json").option("path", f"{out}/rows").option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.text) for r in spark.read.schema("path string, text string").json(f"{out}/rows").collect())

    first = run()
    assert [p for p, _ in first] == ["c.py", "pkg/__init__.py", "pkg/_util.py"]
    with open(f"{root}/new.py", "w") as f:
        f.write("n")
    with open(f"{root}/c.py", "w") as f:
        f.write("changed")
    assert run() == sorted([*first, ("c.py", "changed"), ("new.py", "n")])
    assert len(run()) == 5


def test_an_empty_folder(spark, tmp_path):
    assert tree.source_tree(spark, str(tmp_path)).collect() == []
