"""Mixing sources to target weights, by DataFrame operations alone.

Every document has a hash in [0, 2^56). A source takes all its documents a whole number of times and, once more, those
whose hash is under a threshold. Thresholds come from sums of words by source and hash bucket, made finer only in the
bucket in which the budget ends; no document is sorted but those of the very hash at which it ends, and a larger budget
takes all that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import fresh, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words; a source gives at most MOST_TIMES its words.
SHARE, MOST_TIMES = 1.5, 2
#: Each of the 4 levels of buckets resolves so many bits of the hash.
LEVEL_BITS, LEVELS = 14, 4
_TOP = 1 << (LEVEL_BITS * LEVELS)


def words(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A document's place in [0, 2^56): the first 14 hex digits of the md5 of its id as text, or, if that's null, of its
    text's md5 (null as empty)."""
    named = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 14), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """source, source_size -> those and target: sources by code point, null last, weigh `weights` in turn and share
    `share` of all sizes; what is over `most` times a source's size is shared again by weight until none is above.

    With sources in order of cap / weight, the level (words per weight) at which the first k sources are capped is what
    their caps leave over for the weights of the others; the right k is the first whose level doesn't reach the next cap.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % n
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    t = t.withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("k", "level"))
    t = t.withColumn("right", F.min(fits).over(everything)["level"])
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("right") * F.col("weight"), F.col("cap"))).alias("target"))


def _ending(sums: DataFrame, edge: DataFrame) -> DataFrame:
    """s, bucket, words -> s and b: of each source the first bucket (with words and until, the words up to its end) up to
    which its words reach its rest. First over runs of 2^7 buckets, then over those of one run, so that no task puts more
    than 2^7 sums of a source in order, however many documents it has."""
    rest = edge.select(F.col("source").alias("e"), "rest")

    def first(rows: DataFrame, at: str, before: Column) -> DataFrame:
        until = before + F.sum("words").over(Window.partitionBy("s").orderBy(at))
        reached = rows.withColumn("until", until).join(rest, F.col("s").eqNullSafe(F.col("e"))).where("until >= rest")
        return reached.groupBy("s").agg(F.min(F.struct(at, "words", "until")).alias("b"))

    run = F.shiftright("bucket", LEVEL_BITS // 2)
    runs = first(sums.groupBy("s", run.alias("run")).agg(F.sum("words").alias("words")), "run", F.lit(0))
    runs = runs.select(F.col("s").alias("of"), "b.run", (F.col("b.until") - F.col("b.words")).alias("before"))
    return first(sums.join(runs, F.col("s").eqNullSafe(F.col("of")) & (run == F.col("run"))), "bucket", F.col("before"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, size, place and source, source_size, target -> goals with copies (whole times that all documents are
    taken), threshold (documents with a place below it are taken once more) and quota (words to take of those at it).

    Level by level the sums by source and bucket show the bucket in which the budget ends; the next level reads that
    bucket alone. Sums are made before they are shuffled, so a source with most documents costs 2^14 sums a task at most,
    which go by source and bucket.
    Tables of sources are written, so their sizes are known: Spark broadcasts them only below its own threshold.
    """
    goals = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    edge = goals.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        width = 1 << (LEVEL_BITS * (LEVELS - level))
        rows = sized
        if level > 1:
            found = edge.select(F.col("source").alias("s"), "low")
            rows = sized.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * (1 << LEVEL_BITS)))
        sums = rows.groupBy(F.col("source").alias("s"), F.shiftright("place", LEVEL_BITS * (LEVELS - level)).alias("bucket")).agg(F.sum("size").alias("words"))
        # the first bucket that reaches the budget; without one, the whole range fits under it
        first = _ending(sums, edge)
        edge = edge.join(first, F.col("source").eqNullSafe(F.col("s")), "left")
        low = F.coalesce(F.col("b.bucket") * width, F.col("low"))
        before = F.coalesce(F.col("rest") - (F.col("b.until") - F.col("b.words")), F.col("rest"))
        edge = edge.select("source", "source_size", "target", "copies", before.alias("rest"), low.alias("low"))
        edge = written(edge, f"edge{level}")  # a row for each source; the levels don't run again in later plans
    some = F.when(F.col("target") > F.col("copies") * F.col("source_size"), F.col("low")).otherwise(F.lit(0).cast("long"))
    return edge.select("source", "source_size", "target", "copies", some.alias("threshold"), F.when(F.col("target") > F.col("copies") * F.col("source_size"), F.col("rest")).otherwise(F.lit(0.0)).alias("quota"))


def _times(rows: DataFrame, names: dict[str, str], order: list) -> DataFrame:
    """rows, which have columns place, size, copies, threshold, quota and source by the given names, with times. Documents
    at their source's threshold are taken in order, each if that brings the words nearer to the target; they're few, as only
    equal ids (or equal texts without one) share a place."""
    c = {k: F.col(v) for k, v in names.items()}
    at = c["place"] == c["threshold"]
    until = F.sum(c["size"]).over(Window.partitionBy(c["source"], c["place"]).orderBy(c["size"], *order).rowsBetween(Window.unboundedPreceding, 0))
    inside = (c["quota"] > 0) & (2 * until - c["size"] <= 2 * c["quota"])
    others = rows.where(~at).withColumn(names["times"], c["copies"] + (c["place"] < c["threshold"]).cast("long"))
    return others.unionByName(rows.where(at).withColumn(names["times"], c["copies"] + inside.cast("long")))


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The narrow table id, source, size, place and the sources' table source, source_size, target, copies, threshold, quota.

    Repeated ids share a place, as equal texts without id do, but are taken one by one; null texts have size 0; null is a
    source like any other, last in order; an empty table gives two empty tables. Other columns aren't read.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), place(F.col(id_col), F.col(text_col)).alias("place")), "sized")
    sizes = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    return sized, thresholds(sized, sizes)


def takes(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each row of sized with source_size, target and times, how often the mix takes it. The sources' table is broadcast
    only while it's small (Spark's own threshold); sources of any number and size join by shuffle else."""
    cuts = cuts.withColumnRenamed("source", "s")
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return _times(joined, {k: k for k in ("source", "place", "size", "copies", "threshold", "quota", "times")}, [])


def mixed(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with all their columns and `times`, how often it takes each (replaced if the input
    has such a column)."""
    _, cuts = mix(docs, weights=weights, share=share, most=most, id_col=id_col, text_col=text_col, source_col=source_col)
    docs = docs.drop("times")
    added = ["source", "copies", "threshold", "quota", "place", "size"]
    names = dict(zip(added, fresh(docs, *(f"{x} of mix" for x in added)), strict=True)) | {"times": "times"}
    cuts = cuts.select(*(F.col(x).alias(names[x]) for x in added[:4]))
    joined = docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col(names["source"])))
    text = F.col(text_col).cast("string")
    joined = joined.withColumn(names["place"], place(F.col(id_col), F.col(text_col))).withColumn(names["size"], words(text))
    return _times(joined, names, [F.xxhash64(text)]).drop(*(names[x] for x in added)).where("times > 0")
