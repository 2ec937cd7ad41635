"""Operators over whole tables, against brute force on small ones."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, lines, mixing, ngram_join, topk, toxicity
from millrace.llm._text import BLANK, Words, chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- top k


def best(rows, k=5):
    ok = [(i, [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out |= {(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("shard", [7, 8192])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(5)]) for i in range(0, 400, 10)]
    rows += [(50, None), (None, [1.0] * 5), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [1.0, float("nan"), 0.0, 0.0, 0.0]), (53, [float("inf")] * 5), (100, [1.0, 2.0]), (7, [3.0, 4.0]), (150, [])]
    rows += [rows[5], (1000, [2.0**40, -(2.0**40), 1.0])]  # a row twice, and one without partners
    rows += [(1, [2.0**40, 3.0, 5.0])]
    rows += [(200, [1e308, 0.5, -1.0, 2.0]), (3, [-1e308, 0.25, 1.0, 1.0]), (4, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for _ in range(2):
        got = topk.top_k(frame, frame.filter("vec_id % 50 = 0")).collect()
        assert {tuple(r) for r in got} == best(rows) and len(got) == len(best(rows))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, empty).count() == 0


def test_cutoff_spares_products():
    """With a cutoff, few entries are taken beyond the first slice, and none is lost."""
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(40, 64))
    x = centre[rnd.integers(0, 40, 3000)] + 0.2 * rnd.normal(size=(3000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    q, score = x[:100], x[:100] @ x.T
    cut = np.sort(score, axis=1)[:, -6]
    taken = np.zeros(score.shape, bool)
    for row, col, s in topk._reaching(q, x, cut, 4):
        taken[row, col] = True
        assert (score[row, col] == s).all()
    assert (taken | (score < cut[:, None])).all() and taken.mean() < 0.05


# --- lines


def kept_lines(rows):
    """Windows of three lines that stood before, in plain Python."""
    seen, out = set(), {}
    for i, t, _ in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        every = None if t is None else t.split("\n")
        said = [(p, x.strip("".join(map(chr, range(33))))) for p, x in enumerate(every or []) if x.strip("".join(map(chr, range(33))))]
        gone = set()
        for a, b, c in zip(said, said[1:], said[2:]):
            window = (a[1], b[1], c[1])
            gone |= {a[0], b[0], c[0]} if window in seen else set()
            seen.add(window)
        out[i] = (None if t is None else "\n".join(x for p, x in enumerate(every) if p not in gone), len(every or []), len(gone))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_PLACES", hot)
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice(["a", " b", "c ", "", "d\t", "e"]) for _ in range(rnd.randrange(14))), "s") for i in range(80)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "x\ny", "s"), (103, "x\ny", "s"), (None, "q1\nq2\nq3", "s"), (104, "q1\nq2\nq3", "s"), rows[3]]
    docs = frame(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == kept_lines(rows)
    named = lines.dedup_lines(docs, counts=("n", "m"))
    assert {r.n_lines for r in named.collect()} == {"clash"} and named.columns[-2:] == ["n", "m"]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_long_runs_of_blanks(spark):
    """A run of blanks within a line, at an end or on its own costs in proportion to its length."""
    texts = ["a" + " " * 1_000_000 + "b\nc\nd", "\t" * 1_000_000 + "a\nc\nd\n" + "\x00" * 1_000_000]
    began = time.perf_counter()
    got = lines.dedup_lines(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", "n_lines", "n_removed").collect()
    assert time.perf_counter() - began < 20 and sorted(map(tuple, got)) == [(0, 3, 0), (1, 4, 0)]


def test_frequent_windows_are_dealt_over_tasks(spark, monkeypatch):
    """No salt of a passage that all documents hold has more than the bound's rows, give or take chance."""
    monkeypatch.setattr(lines, "HOT_PLACES", 50)
    seen = []
    join = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, other, on=None, how=None: (seen.append(self) if on == ["a", "b", "salt"] else None) or join(self, other, on, how))
    docs = frame(spark, [(i, f"own {i}\nx\ny\nz", "s") for i in range(2000)])
    assert lines.dedup_lines(docs).filter("n_removed = 3").count() == 1999
    most = seen[0].groupBy("a", "b", "salt").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 50


def test_very_long_documents(spark):
    text = "\n".join(f"line {i} of a very long text, {i} of it" for i in range(200_000))
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, [(1, text, "s"), (2, text + "\nmore", "s")])).collect()}
    assert got[1].n_removed == 0 and got[1].text == text and (got[2].text, got[2].n_removed) == ("more", 200_000)


# --- mixing


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 60))), rnd.choice(["b", "a", "é", "big", "big", "big", None])) for i in range(600)]
    rows += [(600, None, "a"), (601, "", "empty"), rows[0], (None, "x y", "a"), (602, "one", "tiny")]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert len(got) == len(rows)
    source = {(i, t): s for i, t, s in rows}
    sizes, taken, target = {}, {}, {}
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault(i, s)
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    assert source is not None and all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], itertools.cycle((1, 2, 3))))
    left, share, open_ = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), {*sizes}
    while True:  # share out, cap, share the excess out again
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > 3 * sizes[s]}
        share |= {s: unit * weights[s] for s in open_} | {s: 3.0 * sizes[s] for s in full}
        if not full:
            break
        left, open_ = left - sum(3 * sizes[s] for s in full), open_ - full
    assert all(target[s] == pytest.approx(share[s]) for s in sizes)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix(frame(spark, [(1, None, None)])).first().taken == 0


def test_chances_meet_what_is_left(spark):
    """Certain documents are taken out first; the others' chances are in proportion to their size, below one, and expect what is left."""
    rnd = random.Random(4)
    for left in (3.0, 500.0, 2500.0):
        sizes = {rnd.randrange(1, 40): rnd.randrange(1, 9) for _ in range(20)} | {700: 2, 300: 1}
        rows = [("s", k, n, left) for k, n in sizes.items()]
        got = mixing._chances(spark.createDataFrame(rows, "source string, size long, n long, __left double"), True).first()
        certain = sum(k * n for k, n in sizes.items() if k > got["__tau"])
        chance = {k: got["__rate"] * k for k in sizes if k <= got["__tau"]}
        assert all(p < 1 for p in chance.values()) and got["__rest"] == pytest.approx(left - certain)
        assert certain + sum(sizes[k] * k * p for k, p in chance.items()) == pytest.approx(left)
        above = sorted(k for k in sizes if k > got["__tau"])
        rest = {k: n for k, n in sizes.items() if k <= (above[0] if above else 0)}  # the next one up would not fit
        assert not above or (left - sum(k * sizes[k] for k in above[1:])) * above[0] >= sum(k * k * n for k, n in rest.items())


def test_many_sources_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    rows = [(i, "w " * (i % 7), f"s{i % 5}") for i in range(200)] + [(500, "word " * 1_000_000, "s1")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and next(r.size for r in got if r.doc_id == 500) == 1_000_000
    monkeypatch.setattr(mixing, "FEW_SOURCES", 100)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()))


# --- components


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_components(spark, part):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3)]
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), part)
    assert {r.v: r.root for r in got.collect()} == root
    assert components.components(spark.createDataFrame([], "a long, b long"), part).count() == 0


# --- n-gram join


def brute_join(rows, k=5, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block, hot, merged", [(1 << 20, 1024, 512), (60, 4, 0)])
def test_join(spark, monkeypatch, block, hot, merged):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "MERGED", merged)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(3))
    base = [[word() for _ in range(rnd.choice([3, 8, 30, 60]))] for _ in range(12)]
    common = [word() for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = word()
        w = w + common if rnd.random() < 0.3 else w
        rows.append((i * 7 % 160, " ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, " \t", "s"), (903, "a b", "s"), (904, "A\x0bB", "s"), (905, "a  b c", "s"), (906, "x " * 20_000, "s"), (None, "a b", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows).withColumn("n", F.lit("clash"))).collect()}
    want = brute_join(rows)
    assert got == want | {None: (1, None)}
    without = ngram_join.ngram_join(frame(spark, rows), links=False)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in without.collect()} == got and "n_links" not in without.columns
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block, merged", [(1 << 20, 512), (200, 0)])
def test_links_are_counted(spark, monkeypatch, block, merged):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MERGED", merged)
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(rnd.choice(base))
        w[rnd.choice([0, 59, 30])] = f"x{rnd.randrange(4)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(100, "", "s"), (101, "alone", "s"), (None, rows[0][1], "s"), (0, rows[0][1], "s")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t, _ in rows if i is not None}
    want = {i: sum(i != j and bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_links for r in got} == want | {None: None} and max(want.values()) > 20


def test_index_finds_all_links():
    for seed in range(40):
        rnd = random.Random(seed)
        base = [[rnd.randrange(10**6) for _ in range(rnd.randrange(1, 60))] for _ in range(6)]
        sets = []
        for _ in range(rnd.randrange(2, 60)):
            b = {*rnd.choice(base)}
            for _ in range(rnd.randrange(len(b) // 3 + 1)):
                b.remove(rnd.choice(sorted(b)))
                b.add(rnd.randrange(10**6))
            sets.append(np.array(sorted(b), np.uint64))
        ids = list(range(100, 100 + len(sets)))
        rnd.shuffle(ids)
        root = dict(zip(ids, ids))
        links = [(ids[a], ids[b]) for a, b in itertools.combinations(range(len(sets)), 2) for n in (len(np.intersect1d(sets[a], sets[b])),) if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
        for _ in ids:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        assert dict(ngram_join.Index(ids, sets).join()) == {i: r for i, r in root.items() if i != r}


# --- toxicity


def sentences(rnd, n, bad):
    clean = [f"{a}{b}" for a in ("thr", "wh", "st", "ed", "on", "er", "an", "ing") for b in ("ea", "nd", "ou", "at", "re", "ly")]
    insults = ["idiot", "moron", "scum", "worthless"]
    out = []
    for i in range(n):
        w = [rnd.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            for _ in range(2):
                x = rnd.choice(insults)
                if bad:
                    at = rnd.randrange(1, len(x))
                    x = x[:at] + rnd.choice(["*", ".", "x"]) + x[at:]
                w[rnd.randrange(30)] = x
        out.append((" ".join(w[:15]) + ". " + " ".join(w[15:]), int(i % 3 == 0)))
    return out


def test_toxicity_holds_out_and_tolerates_gaps():
    rnd = random.Random(6)
    known = sentences(rnd, 300, False)
    model = toxicity.fit([t for t, _ in known], [y for _, y in known])
    for bad in (False, True):
        new = sentences(rnd, 150, bad)
        import pyarrow as pa

        score = np.concatenate([model.scores(Words(raw, offs, BLANK)) for _, _, raw, offs in chunks(pa.array([t for t, _ in new]))])
        assert ((score >= 0.5) == np.array([y for _, y in new])).mean() > 0.95


def test_kernel_is_symmetric_and_close_for_gaps():
    k = toxicity.Kernel([b"idiot", b"station"])

    def with_(word):
        near, value = k.near(*toxicity._sequences(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])))
        return value[0] if len(near) else np.zeros(2)

    assert with_(b"idiot")[0] == pytest.approx(1) and with_(b"idxiot")[0] > 0.45 and with_(b"id.iot")[0] == pytest.approx(1) and not with_(b"zebra").any()


def naive_kernel(a, b):
    """Four characters in order, at most two skipped in all, each skip weighing DECAY; bounds count as characters."""

    def parts(word):
        c, out = "^" + word + "$", {}
        for at in itertools.combinations(range(len(c)), 4):
            gaps = at[3] - at[0] - 3
            if gaps <= 2:
                key = "".join(c[i] for i in at).replace("$", "^")
                out.setdefault(key, []).append(0.6**gaps)
        return out

    x, y = parts(a), parts(b)
    norm = lambda p: math.sqrt(sum(w * w for ws in p.values() for w in ws))
    return min(1.0, sum(sum(x[u]) * sum(y[u]) for u in x.keys() & y.keys()) / (norm(x) * norm(y)))


def test_kernel_is_that_of_all_subsequences():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9))) for _ in range(40)]
    words += [w[:2] + "x" + w[2:] for w in words[:20]]
    k = toxicity.Kernel([w.encode() for w in words[:12]])
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    near, value = k.near(*toxicity._sequences(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))
    got = np.zeros((len(words), 12))
    got[near] = value
    want = np.array([[naive_kernel(a, b) for b in words[:12]] for a in words])
    clear = np.abs(want - toxicity.NEAR) > 1e-4  # rounding may put others on either side
    assert np.abs(got - np.where(want < toxicity.NEAR, 0, want))[clear].max() < 1e-5


def test_repeated_ids_change_nothing_between_reruns(spark):
    rnd = random.Random(9)
    known = sentences(rnd, 120, False)
    rows = [(i % 60, t, "s") for i, (t, _) in enumerate(known)]
    labels = spark.createDataFrame([(i, 1, known[i][1]) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, toxicity.report(frame(spark, rows).repartition(n), labels).collect())) for n in (1, 4))
    assert a == b


def test_toxicity_queries(spark):
    rnd = random.Random(7)
    known = sentences(rnd, 200, False)
    rows = [(i, t, "s") for i, (t, _) in enumerate(known)] + [(500, None, "s"), (501, "", "s"), (None, "idiot moron", "s"), (502, "idiot " * 5000, "s")]
    docs = frame(spark, rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(known)] + [(999, 0, 1), (0, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    held = [i for i in range(200) if got[i].held_out]
    assert sum(got[i].predicted == known[i][1] for i in held) >= 0.95 * len(held) and got[501].predicted == 0 and got[502].predicted == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}


def test_labels_outside_the_fit_change_nothing(spark):
    rnd = random.Random(8)
    known = sentences(rnd, 90, False)
    docs = frame(spark, [(i, t, "s") for i, (t, _) in enumerate(known)])
    label = lambda flip: spark.createDataFrame([(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, (_, y) in enumerate(known)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, toxicity.report(docs, label(flip)).collect())) for flip in (False, True))
    assert a == b
