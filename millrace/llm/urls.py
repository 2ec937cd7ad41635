"""URL filters: rules by host and path first, then a score of the words that host and path are made of.

Hosts and paths are cut into names, runs of letters. A name that several words were written together in
is split by a unigram model: Viterbi's best sequence of words by their counts in texts, an unknown word
costing ten times more with each letter. Multinomial naive Bayes scores the words. It learns from all
addresses: those among whose words one of `BLOCKED` stands are examples of one side, the others of the
other, so words that keep such company count too, and words of both sides, like `net`, don't. Rules
take no part in that: they speak of places, not of words.

Addresses that agree but for numbers in the path are one shape, counted and scored once; splitting looks
up only the counts of what stands within a name, by a join, so no dictionary is sent. Of the model, sums of
`BUCKETS` hashed words reach the driver, a bounded number. Null addresses and those without `://` have an
empty host and path, no word and a score from the sides' sizes alone; equal rows each give a row; in an
empty table nothing is learnt. Other columns pass through, but for those of the names that are added.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import scan, written

#: The stated rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark an address as an example of the blocked side.
BLOCKED = tuple(
    """ads adserver adult banner bet bets betting camgirls casino cialis clickbait cracked doubleclick escort escorts gambling hentai
    jackpot keygen lottery malware nude phishing pills poker popunder porn porno roulette sex slots spam sportsbook steroids tracker
    track tracking viagra warez xxx""".split()
)
#: Words that names are often made of, beside those of the texts.
COMMON = tuple(
    """art auto best big blog book books buy car cards cash cheap city click club cloud daily deal deals digital easy farm fast food free
    game games get girl girls go gold group health help home host hot hotel house info job jobs land life link links live love mail map
    market master media men money my net network new news now on online open page park pay pharma phone photo play plus pro radio review
    school science server shop site soft space sport sports star store tech the time top tour town trade travel video web win wiki women
    work world zone""".split()
)
#: Letters of the longest word that a name may be split into; its share of all counts that a listed word has at least.
LONGEST, LISTED_SHARE = 24, 1e-5
#: Places of a name whose words are sent on at a time.
PLACES = 2000
#: Hashed words of the model, and what each is taken to have been seen beside its count.
BUCKETS, SMOOTHING = 1 << 18, 0.1

_AZ = (string.ascii_uppercase, string.ascii_lowercase)
ADDED = ("host", "path", "rule", "words", "score", "verdict")


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ? or #, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), *_AZ)


def path_of(url: Column) -> Column:
    """After the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """struct(rule, verdict): the longest rule that fits host and path, of equally long ones the first; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed([*rules]), key=lambda r: len(r[1])):  # later ones take precedence
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(w, n): words of letters, lower-cased, of texts whose markup is left out."""
    plain = F.lower(F.regexp_replace(F.col(column), "<[^<>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("w"))
    return words.filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).cast("double").alias("n"))


def split_name(name: str, counts: dict[str, float], total: float) -> list[str]:
    """The likeliest words that make the name; of equally likely ones, those whose last word is the longest."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    unknown = [-math.log(total) - (k - 1) * math.log(10) for k in range(LONGEST + 1)]
    for i in range(1, len(name) + 1):
        for j in range(max(0, i - LONGEST), i):
            n = counts.get(name[j:i])
            at = best[j] + (math.log(n / total) if n else unknown[i - j])
            if at > best[i]:
                best[i], back[i] = at, j
    out = []
    i = len(name)
    while i:
        out.append(name[back[i] : i])
        i = back[i]
    return out[::-1]


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names; counts: (w, n)."""
    counts = written(counts)
    listed = names.sparkSession.createDataFrame([(w,) for w in sorted({*BLOCKED, *COMMON})], "w string")
    total = max(1.0, counts.agg(F.sum("n")).first()[0] or 0.0)
    known = counts.unionByName(listed.withColumn("n", F.lit(max(1.0, LISTED_SHARE * total)))).groupBy("w").agg(F.max("n").alias("n"))
    keyed = names.select(F.md5("name").alias("k"), "name")

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, name in zip(*(c.to_pylist() for c in batch.columns)):
            for at in range(0, len(name), PLACES):
                found = list({name[i:j] for i in range(at, min(at + PLACES, len(name))) for j in range(i + 1, min(i + LONGEST, len(name)) + 1)})
                yield pa.RecordBatch.from_pydict({"k": [k] * len(found), "w": found})

    within = scan(keyed, ["k", "name"], parts, "k string, w string").join(known, "w").groupBy("k").agg(F.collect_set(F.struct("w", "n")).alias("known"))
    looked = keyed.join(within, "k", "left")

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = batch.to_pydict()
        words = [split_name(name, {x["w"]: x["n"] for x in known or ()}, total) for name, known in zip(rows["name"], rows["known"])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return scan(looked, ["name", "known"], split, "name string, words array<string>")


def _words_of(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """The shapes with their words, in order; those of the path and numbers are marked."""
    each = F.concat(
        F.transform(F.regexp_extract_all(F.col("__host"), F.lit(r"\p{L}+"), F.lit(0)), lambda x: F.struct(x.alias("name"), F.lit("").alias("mark"))),
        F.transform(F.regexp_extract_all(F.lower("__shape"), F.lit(r"\p{L}+"), F.lit(0)), lambda x: F.struct(x.alias("name"), F.lit("/").alias("mark"))),
    )
    said = written(shapes.select("__host", "__shape", "__n", F.posexplode_outer(each).alias("at", "x")).select("__host", "__shape", "__n", "at", "x.*"))
    split = split_names(said.select("name").filter("name is not null").distinct(), counts)
    marked = F.transform("words", lambda w: F.concat("mark", w))
    both = said.join(split, "name", "left").groupBy("__host", "__shape", "__n").agg(F.array_sort(F.collect_list(F.struct("at", marked.alias("words")))).alias("said"))
    return both.select("__host", "__shape", "__n", F.flatten(F.transform("said", lambda s: F.coalesce(s["words"], F.array().cast("array<string>")))).alias("words"))


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit(shapes: DataFrame) -> tuple[np.ndarray, float]:
    """Each hashed word's log odds of the blocked side, and those of an address without words; counts are of all addresses."""
    marked = F.array(*(F.lit(m + w) for w in BLOCKED for m in ("", "/")))
    sided = shapes.select("__n", "words", F.arrays_overlap("words", marked).cast("int").alias("bad"))
    sizes = {r.bad: r.n for r in sided.groupBy("bad").agg(F.sum("__n").alias("n")).collect()}
    each = sided.select("__n", "bad", F.explode(_buckets(F.col("words"))).alias("b")).groupBy("b")
    sums = each.agg(F.sum(F.col("__n") * F.col("bad")).alias("bad"), F.sum(F.col("__n") * (1 - F.col("bad"))).alias("good")).collect()
    seen = np.zeros((2, BUCKETS))
    for r in sums:
        seen[:, r.b] = r.good, r.bad
    share = np.log(seen + SMOOTHING) - np.log(seen.sum(axis=1, keepdims=True) + SMOOTHING * max(1, len(sums)))
    unseen = seen.sum(axis=0) == 0
    return np.where(unseen, 0.0, share[1] - share[0]), math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))


def judge(pages: DataFrame, counts: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """All columns of the pages, and: host, path, rule (null if none fits), words, score (of the blocked side, 0 to 1), verdict (allow or block)."""
    kept = [c for c in pages.columns if c not in ADDED]
    parsed = pages.select(*kept, host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    parsed = parsed.withColumn("__shape", F.regexp_replace("__path", r"\p{Nd}+", "0"))
    shapes = written(_words_of(parsed.groupBy("__host", "__shape").agg(F.count(F.lit(1)).alias("__n")), counts))
    weights, lean = fit(shapes)
    sent = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        at, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        run = np.concatenate([[0.0], np.cumsum(sent.value[at].astype(np.float64))])
        odds = np.clip(lean + run[ends[1:]] - run[ends[:-1]], -700, 700)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(1 / (1 + np.exp(-odds)))], ["__host", "__shape", "words", "score"])

    hashed = shapes.withColumn("__b", _buckets(F.col("words")))
    scored = scan(hashed, ["__host", "__shape", "words", "__b"], score, "__host string, __shape string, words array<string>, score double")
    rule = rule_of(F.col("__host"), F.col("__path"), rules)
    both = parsed.join(scored, ["__host", "__shape"]).withColumn("__rule", rule)
    said = F.coalesce("__rule.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return both.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), "words", "score", said.alias("verdict"))


def report(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "score")
