"""Mixing sources to target weights with hash-threshold histograms.

Targets: sources share the whole size by weight; a source's target stops at ``MOST_EPOCHS`` times its own size and what is over goes to
the others by weight, again until none is above. Every round is one sum over the sources still open.

A source's target is so many whole passes over it and a rest. The rest is taken by hash: every document has a fixed hash of ``HASH_BITS``
bits, and the documents below a threshold go in once more. The threshold comes from histograms of tokens by source and hash bucket: running
sums give the bucket in which the budget ends, only the rows of that boundary bucket are counted again at the next bits, until it holds one
document, and the documents are filtered by comparing hashes. That document goes in if it brings the sum nearer to the budget. Nothing is sorted by document,
budgets are nested (a larger budget keeps every document of a smaller one, and takes none less often), and a source with a third of all rows is one set of
bucket sums like any other.

Equal rows (same id and text) share a hash. Where the boundary falls among them, histograms over their positions (of a written table) decide, so as many
of them are taken as the budget needs; which of them makes no difference.

Defined results: a null text has size 0; null is a source of its own, last in order. Documents of size 0 are in the result with
taken 0. An empty table gives an empty result. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.batches import checkpointed, refuse_names
from tarn.llm.shards import local_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Hexadecimal digits of the hash, its bits, and the bits that each histogram resolves.
DIGITS = 15
HASH_BITS, LEVEL = 4 * DIGITS, 12
#: The same for a row's position; a histogram has a row for each position at most.
PLACE_BITS, PLACE_LEVEL = 63, 21
#: Sources (a row of about 100 bytes each) that may be broadcast, and the parts of a source beyond that.
MOST_BROADCAST, SALTS = 20_000, 32


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text: starts of words, counted after one pass that maps the blanks to one character."""
    same = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(same, " ", -1), "")).cast("long")


def place_in_order(seed: int, doc_id: Column, text: Column) -> Column:
    """The hash: the leading digits of an MD5 over seed, id and text, so that other systems can compute it."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, DIGITS), 16, 10).cast("long")


def numbered_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, n): sources in the order of their code points, null last, numbered from 0."""
    row = (1 << 33) - 1
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    placed = checkpointed(sizes.withColumn("at", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("at", 33).alias("p")).count().collect())  # one for each sorted partition
    offsets, before = [], 0
    for p, n in counts:
        offsets.append({"p": p, "before": before})
        before += n
    joined = placed.join(F.broadcast(local_table(sized, offsets, "p bigint, before bigint")), F.shiftright("at", 33) == F.col("p"))
    return joined.select("source", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit(row))).alias("n"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source: source, source_size and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    weighed = checkpointed(numbered_sources(sized).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    level, closed = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        sums = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if sums[0] is None or sums[3] == closed:
            break
        level, closed = (sums[0] - (sums[1] or 0.0)) / sums[2], sums[3]
    return weighed.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def beside(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with the row of their source in ``plan`` (its column ``s``). While sources are few the plan is broadcast, so a source with most of the
    rows stays spread; beyond that every source is dealt over ``SALTS`` parts on both sides."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if few:
        return rows.join(F.broadcast(plan), same).drop("s")
    dealt = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", (F.col("hash") % SALTS).cast("int"))
    return salted.join(dealt, same & (F.col("__salt") == F.col("__part"))).drop("s", "__part", "__salt")


def ending(histogram: DataFrame, low: Column, by: str) -> DataFrame:
    """The rows, one for each source at most, at which the running sum of tokens, on top of ``low``, passes ``left``; ``before`` is the sum up to them."""
    before = low + F.sum("tokens").over(Window.partitionBy("source").orderBy(by)) - F.col("tokens")
    return histogram.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("tokens") > F.col("left")))


def boundary(histogram: DataFrame, level: int) -> DataFrame:
    """(h, bucket, before, here, several) of the bucket in which a source's budget ends, if any. Runs of buckets are summed first, so no
    source has more than 2^(level / 2) rows in a window."""
    half = level // 2
    coarse = histogram.groupBy("source", F.shiftright("bucket", half).alias("run")).agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    run = ending(coarse, F.lit(0), "run").select(F.col("source").alias("h"), "run", F.col("before").alias("low"))
    fine = histogram.join(run, F.col("source").eqNullSafe(F.col("h")) & (F.shiftright("bucket", half) == F.col("run"))).drop("h", "run")
    return ending(fine, F.col("low"), "bucket").select(F.col("source").alias("h"), "bucket", "before", F.col("tokens").alias("here"), F.col("n").alias("several"))


def refine(rows: DataFrame, budgets: DataFrame, key: str, bits: int, most: int, few: bool) -> DataFrame:
    """For each row (source, left) of ``budgets``: rows whose ``key`` is below ``end`` come nearest to ``left`` tokens. ``tie``: the key at which
    the budget ends among several rows, which are then not below ``end``; ``left`` is what is left for them (else tie is null)."""
    found = budgets.select("source", "left", F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("settled"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("n"), F.lit(bits).alias("below"))
    below = bits
    while below > 0:
        level = min(most, below)
        open_ = found.where("not settled").select(F.col("source").alias("s"), "prefix", "left")
        inside = beside(rows, open_, few).where(F.shiftright(key, below) == F.col("prefix"))
        below -= level
        parts = inside.groupBy("source", F.shiftright(key, below).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
        at = boundary(checkpointed(parts), level)
        step = found.join(at, F.col("source").eqNullSafe(F.col("h")), "left").select(
            "source",
            F.when(F.col("settled"), F.col("left")).otherwise(F.coalesce(F.col("left") - F.col("before"), F.lit(0.0))).alias("left"),
            F.when(F.col("settled"), F.col("prefix")).otherwise(F.coalesce(F.col("bucket"), F.shiftleft(F.col("prefix") + 1, level))).alias("prefix"),
            F.when(F.col("settled"), F.col("below")).otherwise(F.lit(below)).alias("below"),
            F.when(F.col("settled"), F.col("tokens")).otherwise(F.coalesce("here", F.lit(0))).alias("tokens"),
            F.when(F.col("settled"), F.col("n")).otherwise(F.coalesce("several", F.lit(0))).alias("n"),
            (F.col("settled") | F.coalesce(F.col("several") <= 1, F.lit(True))).alias("settled"),
        )
        found = checkpointed(step)  # one row for each source
        if found.where("not settled").isEmpty():
            break
    with_last = (F.col("n") <= 1) & (F.col("left") > 0) & (2 * F.col("left") >= F.col("tokens"))
    end = F.expr("shiftleft(prefix, below)") + F.when(with_last, F.expr("shiftleft(1L, below)")).otherwise(F.lit(0))
    return found.select("source", "left", end.alias("end"), F.when(F.col("settled"), F.lit(None)).otherwise(F.col("prefix")).alias("tie"))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 23, keep: tuple[str, ...] = ("doc_id",), twice: bool = False) -> DataFrame:
    """The ``keep`` columns, source, size, source_size, target, taken and copies (how often the mix takes the document) of every row.

    The numbers of each row are written once (checkpoint). With ``twice`` only those that the plan needs are, and the rows are read a second time
    for the result: for ``keep`` columns as large as the texts, which then are neither written nor shuffled."""
    refuse_names(keep, {"source", "size", "hash", "source_size", "target", "taken", "copies", "passes", "left", "end", "tie", "tie_left", "s", "e", "__place", "__again"})
    named = df.select(*keep, "source", word_count(F.col("text")).alias("size"), place_in_order(seed, F.col("doc_id"), F.col("text")).alias("hash"))
    sized = checkpointed(named.select("source", "size", "hash") if twice else named)
    targets = checkpointed(source_targets(sized, weights, most))
    few = targets.count() <= MOST_BROADCAST
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    ends = refine(sized, plan, "hash", HASH_BITS, LEVEL, few).select(F.col("source").alias("e"), "end", "tie", F.col("left").alias("tie_left"))
    plan = checkpointed(plan.drop("left").join(ends, F.col("source").eqNullSafe(F.col("e"))).drop("e"))
    joined = beside(named if twice else sized, plan.withColumnRenamed("source", "s"), few)
    again = F.col("hash") < F.col("end")
    if not plan.where("tie is not null").isEmpty():
        tied = F.col("hash").eqNullSafe(F.col("tie"))
        ties = checkpointed(joined.where(tied).withColumn("__place", F.monotonically_increasing_id()))
        places = refine(ties, plan.where("tie is not null").select("source", F.col("tie_left").alias("left")), "__place", PLACE_BITS, PLACE_LEVEL, few)
        ties = beside(ties.drop("end"), places.select(F.col("source").alias("s"), "end"), few).withColumn("__again", F.col("__place") < F.col("end")).drop("__place")
        joined = joined.where(~tied).withColumn("__again", again).unionByName(ties)
    else:
        joined = joined.withColumn("__again", again)
    copies = F.least(F.col("passes") + F.col("__again").cast("long"), F.lit(most))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int")
    return joined.withColumn("copies", copies).select(*keep, "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
