"""URL filters: parsing and rules against plain Python, splitting against all splits, the score against sums over all addresses."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import urls

URLS = [
    None, "", "no scheme/at/all", "http://", "https://ORG", "https://x.org", "https://x.org/", "http://example.org/es/1", "http://a.example.org/en/17?x", "http://example.org/en/2",
    "http://com/fr/3", "http://xcom/fr/3", "http://a.com/de/#t", "http://a.com/de?q", "http://b.COM/fr/A/É", "ftp://u:p@Host.net:80/a b/c.html?x=/y#z", "x://y://z/w", "http://a.b/?q=://c.org/",
    "http://free-bets.shop/en/1", "http://freebetscasino.net/en/22", "http://museumofart.net/fr/x_9/", "http://ÄRZTE.net/a", "//a.org/b", "http://" + "q" * 30_000 + ".net/" + "v" * 30_000,
]
TEXTS = ["<p>museum of art of the city</p>", None, "", "Of the ärzte <b>in</b> the city, museum <unclosed", "bets"]


def pages(spark, given=tuple(URLS)):
    return spark.createDataFrame([(i, u, "x", 7) for i, u in enumerate(given)], "page_id long, url string, host string, kept int")


def words(spark, texts=tuple(TEXTS)):
    return urls.word_counts(spark.createDataFrame([(t,) for t in texts], "html string"), "html")


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_rules(spark):
    got = {r.page_id: r for r in urls.judge(pages(spark), words(spark)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parsed(u)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].kept) == (host, path, rule, 7), u
        assert got[i].verdict == (verdict or ("block" if got[i].score > 0.5 else "allow"))
    assert {ruled(*parsed(u))[0] for u in URLS} == {None, *(r for _, r in urls.RULES)}


def test_equally_long_rules(spark):
    row = spark.createDataFrame([("a.org", "/xy")], "h string, p string").select(urls.rule_of(F.col("h"), F.col("p"), [("allow", "org/x"), ("block", "org/x")]).alias("r")).first()
    assert tuple(row.r) == ("org/x", "allow")


def every_split(name):
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in every_split(name[k:]):
            yield [name[:k], *rest]


def test_split_is_the_likeliest_of_all():
    rnd, counts = random.Random(4), {"a": 3.0, "ab": 40.0, "abc": 7.0, "b": 1.0, "bca": 9.0, "ca": 30.0, "cab": 2.0}
    total = sum(counts.values())
    cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total) - (len(w) - 1) * math.log(10)
    for _ in range(200):
        name = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 10)))
        got = urls.split_name(name, counts, total)
        assert "".join(got) == name
        assert sum(map(cost, got)) == pytest.approx(max(sum(map(cost, s)) for s in every_split(name)))


def test_names_are_split_by_the_texts_words(spark):
    names = ["museumofart", "freebetscasino", "ärztecity", "zzqx", "x", "v" * 5000]
    got = {r.name: r.words for r in urls.split_names(spark.createDataFrame([(n,) for n in names], "name string"), words(spark, TEXTS * 50)).collect()}
    assert got["museumofart"] == ["museum", "of", "art"] and got["freebetscasino"] == ["free", "bets", "casino"] and got["ärztecity"] == ["ärzte", "city"]
    assert got["zzqx"] == ["zzqx"] and got["x"] == ["x"] and "".join(got["v" * 5000]) == "v" * 5000


def test_score_is_bayes_over_all_addresses(spark):
    given = ["http://free-bets.net/en/1"] * 3 + ["http://goodbook.net/en/%d" % i for i in range(9)] + ["http://winbets.net/fr/a", "http://win.net/fr/b", None]
    got = urls.judge(pages(spark, given), words(spark)).collect()
    blocked = {m + w for w in urls.BLOCKED for m in ("", "/")}
    seen = {True: Counter(), False: Counter()}
    for r in got:
        seen[bool(blocked & set(r.words))].update(r.words)
    kinds = len(seen[True] | seen[False])
    sides = Counter(bool(blocked & set(r.words)) for r in got)
    share = lambda w, side: (seen[side][w] + urls.SMOOTHING) / (seen[side].total() + urls.SMOOTHING * kinds)
    for r in got:
        odds = (sides[True] + 1) / (sides[False] + 1) * math.prod(share(w, True) / share(w, False) for w in r.words)
        assert r.score == pytest.approx(odds / (1 + odds), rel=1e-4)
    verdicts = {given[r.page_id]: r.verdict for r in got}
    assert verdicts["http://free-bets.net/en/1"] == verdicts["http://winbets.net/fr/a"] == "block" and verdicts["http://goodbook.net/en/3"] == verdicts[None] == "allow"
    assert [r.score for r in urls.judge(pages(spark, given).repartition(3), words(spark)).orderBy("page_id").collect()] == [r.score for r in sorted(got, key=lambda r: r.page_id)]


def test_empty_tables(spark):
    assert urls.report(urls.judge(pages(spark, []), words(spark, []))).collect() == []
    assert {r.verdict for r in urls.judge(pages(spark, [None, "http://a.b/c"]), words(spark, [])).collect()} == {"allow"}
