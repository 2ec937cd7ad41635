"""Mixing sources to target weights by Pareto order sampling.

A source's target is first met by whole copies of all its documents, as often as they fit. What
is left is a sample without replacement: document i is to be included with a chance in proportion
to its size, so that the expected words are what is left. Documents whose chance would be one or more are certain:
they are taken, and what then is left is shared out among the others, until all their chances p are below one. Of these
the rank is u / (1 - u) divided by p / (1 - p), with u uniform, drawn from the document's id and text.
Documents are taken by rising rank while the middle of their words lies within what is left,
so that a source misses its target by half a document at most.

The texts are read once; sizes and draws are written. No source is sorted: chances follow from the numbers of documents
of each size, and the cut is found from words summed by bucket of the rank's logarithm, first coarse, then fine
within the bucket where the cut lies; only the documents of one fine bucket of a source are put in order. Sums are of
whole numbers, so reruns agree. What is known of a source is broadcast for up to `FEW_SOURCES` of them, and joined by a shuffle beyond.

Sizes are words [^\x20\x09-\x0D]+; null and empty texts have none, are worth nothing and are
never taken. Null sources are one source, which comes last. Rows that agree in id and text share
one rank and are taken or left together. Columns of the documents other than id, text, source and `keep` play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.split import numbered
from ._spark import durable, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
_COARSE, _FINE = 64.0, float(1 << 20)
#: Sources up to which per-source rows are broadcast; beyond, they are joined by a shuffle.
FEW_SOURCES = 100_000
_WHOLE = "decimal(38,0)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with `target`: shares of all words by weight, none above `most` times its size.

    The level to which sources are filled in proportion to their weights rises as those that it overfills are taken
    out with what they can hold; each step is one sum over the sources, and the last takes out none.
    """
    named = sources.select("source", "source_size", F.col("source").isNull().alias("__n"), F.encode("source", "UTF-8").alias("__b"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("__r", F.lit(len(weights))) + 1).cast("int"))
    placed = numbered(named, ["__n", "__b"], "__r").select("source", "source_size", weight.alias("__w"), (F.col("source_size") * most).alias("__full"))
    placed = durable(placed)
    level, open_ = 0.0, None
    while True:
        full = F.col("__full").cast("double") / F.col("__w") <= F.lit(level) if open_ is not None else F.lit(False)
        r = placed.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, F.col("__full"))), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("__w"))).alias("w"), F.count_if(~full).alias("n")
        ).first()
        if not r["n"] or r["n"] == open_:
            break
        level, open_ = (float(r["all"]) - float(r["held"])) / r["w"], r["n"]
    return placed.select("source", "source_size", F.least(F.col("__full").cast("double"), F.lit(level) * F.col("__w")).alias("target"))


def uniform(doc: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    said = F.concat_ws("|", F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _with(rows: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """The rows with what is known of their source."""
    known = known.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(known) if few else known, rows["source"].eqNullSafe(known["__s"]), "left").drop("__s")


def _chances(sizes: DataFrame, few: bool) -> DataFrame:
    """(source, __tau, __rate, __rest): documents above __tau words are certain, the others' chance is __rate times their size, and __rest words are left for them.

    sizes: (source, size, n, __left). Going down the sizes, the first is sought whose chance stays below one.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words_of, squares = (F.col("size") * F.col("n")).cast(_WHOLE), F.col("size").cast("decimal(18,0)") * F.col("size").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")
    above = F.coalesce(F.sum(words_of).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum(squares.cast(_WHOLE)).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = sizes.filter("size > 0 and __left > 0").select("source", "size", (F.col("__left") - above.cast("double")).alias("__rest"), upto.cast("double").alias("__squares"))
    fits = each.filter(F.col("__rest") * F.col("size") < F.col("__squares"))
    first = fits.groupBy("source").agg(F.max(F.struct("size", "__rest", "__squares")).alias("f"))
    return first.select("source", F.col("f.size").alias("__tau"), (F.col("f.__rest") / F.col("f.__squares")).alias("__rate"), F.col("f.__rest").alias("__rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, copies and taken (words, copies counted), and the columns in `keep`."""
    doc = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), uniform(F.col(id_col), F.col(text_col), seed).alias("__u"),
        F.struct(*keep).alias("__kept") if keep else F.lit(None).cast("int").alias("__kept"),
    ))
    sizes = durable(doc.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    plan = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("__whole", copies).withColumn("__left", F.greatest(F.lit(0.0), F.col("target") - F.col("__whole") * F.col("source_size")))
    plan = durable(_with(plan, _chances(_with(sizes, plan.select("source", "__left"), few), few), few))

    chance = F.least(F.lit(1.0 - 1e-9), F.greatest(F.lit(1e-12), F.col("__rate") * F.col("size")))
    rank = F.floor((F.log(F.col("__u") / (1 - F.col("__u"))) - F.log(chance / (1 - chance))) * _FINE)
    certain = (F.col("__left") > 0) & (F.col("size") > F.coalesce("__tau", F.lit(0)))
    drawn = F.when((F.col("size") > 0) & (F.col("size") <= F.col("__tau")) & (F.col("__rest") > 0), rank)

    def ranked(known: DataFrame) -> DataFrame:
        each = _with(doc, known, few).withColumn("__x", drawn)
        return each.withColumn("__b", F.floor(F.col("__x") * (_COARSE / _FINE)))

    live = ranked(plan).select("source", "doc_id", "size", "__u", "__rest", "__b", "__x").filter("__x is not null")
    coarse = durable(_cut(live, "__b", "__rest").withColumnsRenamed({"__b": "__b1", "__in": "__in1"}))
    inside = _with(live, coarse, few).filter("__b = __b1")
    fine = durable(_cut(inside, "__x", "__in1").withColumnsRenamed({"__x": "__x1", "__in": "__in2"}))
    order = Window.partitionBy("source").orderBy("__u", "doc_id", "size")
    edge = _with(inside, fine, few).filter("__x = __x1").groupBy("source", "__u", "doc_id", "size", "__in2").agg(F.sum("size").alias("n"))
    ended = edge.withColumn("__end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    key = F.struct("__u", "doc_id", "size")
    last = ended.filter(F.col("__end") - F.col("n") / 2 <= F.col("__in2")).groupBy("source").agg(F.max(key).alias("__last"))
    cuts = _with(_with(coarse.select("source", "__b1"), fine.select("source", "__x1"), few), last, few)

    each = ranked(durable(_with(plan, cuts, few)))
    before = F.col("__b1").isNull() | (F.col("__b") < F.col("__b1")) | (F.col("__b") == F.col("__b1")) & (F.col("__x1").isNull() | (F.col("__x") < F.col("__x1")))
    at_cut = (F.col("__x") == F.col("__x1")) & (key <= F.col("__last"))
    extra = F.when(certain, F.lit(1)).when(F.col("__x").isNotNull() & (F.coalesce(before, F.lit(False)) | F.coalesce(at_cut, F.lit(False))), F.lit(1)).otherwise(F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("__whole") + extra).otherwise(F.lit(0)).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *([F.col("__kept")[c].alias(c) for c in keep]))


def _cut(rows: DataFrame, bucket: str, left: str) -> DataFrame:
    """For each source, the bucket in which its words reach `left`, and what of that the buckets before it leave (__in)."""
    sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("__n"), F.max(left).alias("__left"))
    order = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sums.withColumn("__upto", F.sum("__n").over(order)).withColumn("__in", F.col("__left") - (F.col("__upto") - F.col("__n")))
    return upto.filter((F.col("__upto") > F.col("__left")) & (F.col("__in") >= 0)).select("source", bucket, "__in")


def report(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
