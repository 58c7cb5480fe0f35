"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets counts over its whole text. For each measure, language and source, a sketch of logarithmic buckets
(relative error ``GAMMA - 1`` at most) counts documents by bucket; sketches merge by adding counts, so Spark sums them before the
shuffle, and a source that holds a third of all rows costs no more than any other. A group's quartiles are blended with those of its language,
which are blended with those of the whole table, each as if ``PRIOR`` documents more had them: at any size by the same formula, so small groups lean on
the wider sketch and large ones follow their own. A limit is the upper quartile plus a multiple of the spread between quartiles; documents
beyond a limit are rejected by one joined filter.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Null languages and sources form
groups of their own. Repeated rows are judged alike, one result row for each input row. Columns to keep that are named like the operator's own are an error. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.batches import checkpointed, map_rows, refuse_names

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window whose second occurrence counts as repetition.
WINDOW = 8
#: The base rule: fewest words, and the largest share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Ratio of one sketch bucket to the next.
GAMMA = 1.04
#: How many documents the wider sketch counts for beside a group's own.
PRIOR = 200.0


@dataclass(frozen=True)
class Measure:
    """A share of a document, rejected above upper quartile + ``spreads`` x max(quartile spread, ``floor``)."""

    name: str
    expression: str
    spreads: float
    floor: float


#: The floors keep groups without any spread (most shares are 0 in clean prose) from rejecting a single odd character or line.
MEASURES = (
    Measure("symbol_share", "n_symbols / word_chars", 6.0, 0.005),
    Measure("upper_share", "n_upper / word_chars", 6.0, 0.02),
    Measure("dup_line_share", "n_dup_lines / n_lines", 6.0, 0.08),
    Measure("repeat_share", "n_repeat_words / n_words", 6.0, 0.05),
    Measure("echo_share", "n_echoes / n_words", 6.0, 0.03),
    Measure("word_length", "word_chars / n_words", 8.0, 0.25),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes")


def count_text(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text. Words are runs of anything but the six ASCII blanks."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly those six blanks
    n = len(words)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, SPACES))
    return (
        n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(raw) - len(raw.translate(None, UPPER)), sum(map(operator.eq, words, words[1:])),
    )


def count_texts(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``COUNTS`` (long) of each row; the text itself does not leave the scan."""

    def work(*columns: list) -> dict:
        counts = zip(*map(count_text, columns[-1]))
        return dict(zip(keep, columns)) | dict(zip(COUNTS, map(list, counts)))

    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return map_rows(df, [*keep, text], work, ", ".join([*kept, *(f"{c} bigint" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(counted: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group, measure and filled bucket with its number of documents: the mergeable sketch."""
    shares = F.array(*(F.struct(F.lit(m.name).alias("measure"), F.expr(f"try_divide({m.expression.replace(' / ', ', ')})").cast("double").alias("x")) for m in MEASURES))
    share = counted.select(*group, F.explode(shares).alias("m")).select(*group, "m.*")
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.log(F.lit(GAMMA))).cast("int")).otherwise(F.lit(-10_000))
    return share.where("x is not null").groupBy(*group, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, group: list[str], points: dict[str, float]) -> DataFrame:
    """Values of a sketch at the given points, and its number of documents, for each group and measure."""
    whole = Window.partitionBy(*group, "measure")
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket") == -10_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + F.lit(GAMMA)))
    at = sketch.select(*group, "measure", value.alias("value"), F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("total"))
    return at.groupBy(*group, "measure").agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value"))).alias(name) for name, q in points.items()))


def limits(counted: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row for each (lang, source) with the limit of every measure, from the blended sketches."""
    fine = sketches(counted, ["lang", "source"])
    points = {"low": 0.25, "high": 0.75}
    levels = []
    for group in (["lang", "source"], ["lang"], []):
        merged = fine.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n")) if len(group) < 2 else fine
        levels.append(quantiles(merged, group, points))
    narrow, middle, wide = (x.withColumnsRenamed({c: f"{c}_{i}" for c in ("lang", "source", "total", "low", "high")}) for i, x in enumerate(levels))
    joined = (
        narrow.join(middle, [narrow.measure == middle.measure, narrow.lang_0.eqNullSafe(middle.lang_1)]).drop(middle.measure)
        .join(wide, "measure")
    )
    def blended(c: str) -> Column:
        own = [(F.coalesce(f"total_{i}", F.lit(0)), F.coalesce(f"{c}_{i}", F.lit(0.0))) for i in range(2)]
        out = F.col(f"{c}_2")
        for n, value in reversed(own):
            out = (n * value + F.lit(prior) * out) / (n + F.lit(prior))
        return out

    rules = {m.name: m for m in MEASURES}
    spread = F.create_map(*(F.lit(x) for m in rules.values() for x in (m.name, m.spreads)))
    floor = F.create_map(*(F.lit(x) for m in rules.values() for x in (m.name, m.floor)))
    limit = blended("high") + spread[F.col("measure")] * F.greatest(blended("high") - blended("low"), floor[F.col("measure")])
    return joined.groupBy(F.col("lang_0").alias("limit_lang"), F.col("source_0").alias("limit_source")).agg(*(F.max(F.when(F.col("measure") == name, limit)).alias(f"max_{name}") for name in rules))


#: Groups (a row of about 100 bytes each) whose limits may be broadcast, and the parts of a group beyond that.
MOST_BROADCAST, SALTS = 20_000, 32


def judge(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text", prior: float = PRIOR, twice: bool = False) -> DataFrame:
    """Counts, the limits that apply and ``base_failed``, ``kept`` and ``reason`` of every row.

    ``keep`` must hold lang and source. The counts are written once (checkpoint), since both the sketches and the
    filter need them: rows of a few numbers instead of a second pass over the texts. With ``twice`` texts are counted a second time instead, so
    that large ``keep`` columns (the texts themselves) can go along and are neither written nor shuffled.
    """
    refuse_names(keep, {*COUNTS, "base_failed", "kept", "reason", "limit_lang", "limit_source", *(f"max_{m.name}" for m in MEASURES)})
    counted = count_texts(df, keep, text).withColumn("base_failed", base_failed())
    if not twice:
        counted = checkpointed(counted)
    sketched = counted if not twice else count_texts(df, ("lang", "source"), text).where(~base_failed())
    limit = checkpointed(limits(sketched.where(~base_failed()), prior))
    same = F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source"))
    if limit.count() <= MOST_BROADCAST:
        joined = counted.join(F.broadcast(limit), same, "left")
    else:  # every group is dealt over SALTS parts on both sides
        dealt = limit.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = counted.withColumn("__salt", F.pmod(F.xxhash64(*COUNTS), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, same & (F.col("__salt") == F.col("__part")), "left").drop("__part", "__salt")
    broken = [F.when(F.expr(f"try_divide({m.expression.replace(' / ', ', ')})") > F.col(f"max_{m.name}") * F.lit(GAMMA), F.lit(m.name)) for m in MEASURES]
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*broken))
    return joined.drop("limit_lang", "limit_source").withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
