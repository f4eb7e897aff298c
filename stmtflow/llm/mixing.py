"""Mix sources to target weights.

Sizes are summed per source, targets are filled up by weight until no source exceeds its ceiling, and the
ratio target / size is the source's repetition rate. Each document is emitted floor(rate) times, plus once
more if a number drawn from its id by hash is below the fraction. A rerun, or a task run again after an
executor is lost, draws the same numbers.

Filling: with ceilings c, weights w and the whole T, the targets are min(c, level * w) for the one level at
which they sum to T. Passing the excess over a ceiling on by weight, again and again, ends there. The level
is found by repeating T minus the ceilings reached, over the weights left; each pass is one aggregation over
the sources and only two numbers come back.

Null and empty texts have size 0 and stay, with no words taken. A null source is a source, the last one. Repeated rows and
equal ids draw the same number and are taken alike; null ids draw as empty ones. Sources of size 0 have target 0. Columns of
the added names are replaced; an empty table gives an empty result. Texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import word_count
from stmtflow.plans.materialize import materialize
from stmtflow.plans.ordered import with_ordinal

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2
SEED = "mix"
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_table(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight), weights dealt in turn to the sources by code point, null last.

    Sources are ranked by range partitions, so that however many there are, and however alike their names, they are not
    sorted in one task.
    """
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    ranked = with_ordinal(sums, [F.col("source").asc_nulls_last()], "_rank", first=0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    return ranked.select("source", "source_size", weight.cast("bigint").alias("weight"))


def fill_targets(sources: DataFrame, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Add `target`: share_percent % of all sizes by weight, at most `most` times a source's size."""
    ceiling = F.col("source_size") * most
    whole, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole:
        return sources.withColumn("target", F.lit(0.0))
    amount = whole * share_percent
    level, reached = (amount / (100.0 * weights)), None
    while True:
        full = ceiling.cast("double") < F.lit(level) * F.col("weight")
        n, taken, left = sources.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, ceiling)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == reached or not left:
            break
        reached = n
        level = (amount - 100 * (taken or 0)) / (100.0 * left)
    return sources.withColumn("target", F.least(ceiling.cast("double"), F.lit(level) * F.col("weight")))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the id and the seed fix."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """Add size, source_size, target, copies and taken to each document.

    A null text has size 0. A null source is a source. Sources of size 0 have target 0 and no copies. Documents
    with equal ids draw the same number. Columns of these names in the input are replaced; an empty table
    gives an empty result.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c not in added]
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_own"), word_count("text").alias("size")
    )
    sources = materialize(source_table(sized.select("_own", "size"), "_own", weights), "mix-sources")
    filled = fill_targets(sources, share_percent, most).select(F.col("source").alias("_source"), "source_size", "target")
    if filled.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(filled), F.col("_own").eqNullSafe(F.col("_source")))
    else:
        dealt = filled.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        salted = sized.withColumn("_of", F.pmod(F.xxhash64("_id", "_doc"), F.lit(SALTS)))
        joined = salted.join(dealt, F.col("_own").eqNullSafe(F.col("_source")) & (F.col("_of") == F.col("_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = F.when(draw(F.col("_id"), seed) < rate - whole, 1).otherwise(0)
    return (
        joined.withColumn("copies", (whole + extra).cast("bigint"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_doc.*", *added)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, numbered by `copy` from 0."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, cast(copies as int) - 1)")))
