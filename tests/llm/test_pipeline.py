"""The pipeline's stages, each on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_corpus import brute_join, frame, kept_lines, sentences  # noqa: E402
from test_scans import brute_hits  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    known = sentences(rnd, 120, False)
    rows = [(i, t.replace(". ", ".\n"), f"s{i % 3}") for i, (t, _) in enumerate(known)]
    test = " ".join(f"q{i}" for i in range(14))
    clean = next(t for t, y in known if not y)
    rows += [(200, "before " + test + " after", "s0"), (201, clean.replace(". ", ".\n"), "s1"), (202, clean + " and more", "s2"), (203, None, "s0"), (204, "", "s1"), (None, "no id here", None)]
    block = "\n".join(f"line {i} of a block" for i in range(4))
    rows += [(205, "own start\n" + block, "s0"), (206, "other start\n" + block + "\nother end", "s1")]
    at = tmp_path_factory.mktemp("sf")
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(known)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), dict((i, y) for i, (_, y) in enumerate(known)), test


def test_stages(spark, folder):
    at, toxic, test = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at).persist()
        seen.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = [[(r.doc_id, r.text, r.source) for r in d.collect()] for d in seen[:5]]
    kept = {i for i, _, _ in rows[1]}
    assert all((i in kept) != bool(y) for i, y in toxic.items()) and {200, 203, 204, None} <= kept
    want = {i: t for i, (t, n, gone) in kept_lines(rows[1]).items() if not gone or (t or "").strip()}
    assert {i: t for i, t, _ in rows[2]} == want and "other start\nother end" in want.values()
    assert {i for i, _, _ in rows[3]} == {i for i, (_, c) in brute_join(rows[2]).items() if c == i or i is None}
    assert {i for i, _, _ in rows[4]} == {i for i, t, _ in rows[3] if not brute_hits(t, [(1, test)])[1]}
    assert 200 in {i for i, _, _ in rows[3]} and 200 not in {i for i, _, _ in rows[4]}
    final = seen[5].collect()
    assert final and {r.doc_id for r in final} <= {i for i, _, _ in rows[4]} and all(r.copies >= 1 and r.taken == r.copies * r.size for r in final)
    assert sorted(map(str, corpus_pipeline.run(spark, at).select("doc_id", "copies").collect())) == sorted(map(str, seen[5].select("doc_id", "copies").collect()))


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.col("copies") > 0).count() == 0
