"""95th percentiles at the floor rank: element ``min(floor(0.95 n), n - 1)`` of the sorted values.

Exact ones of groups of any size come by refinement (``with_p95``). A group's count and range show whether its p95 is simply the
maximum; else its values are counted in coarse buckets of that range, about as many as the root of its size; the bucket that
holds the rank is found from those counts, and only that bucket's values are counted one by one. Streams cannot read their rows
again: they keep counts of the values, which are refined likewise when a window has closed, or a sketch (``p95_sketch``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MILLI, to_milli
from ..schemas import FEATURES
from ..session import stored_table

#: ``percentile_disc`` takes element ceil(p n). With p a hair above 0.95 that is floor(0.95 n) + 1
#: for every n below 5e10: exact multiples move up one, all other ranks stay.
_JUST_ABOVE = "0.950000000001D"

#: In groups of so many values or fewer the floor rank is the last one: p95 is the maximum.
LAST_RANK = 20
#: Coarse buckets of a group's range, at most.
BUCKETS = 1024

#: Zero-based floor rank, as a one-based position.
_POSITION = "least(19 * total div 20, total - 1) + 1"


def p95_aggregate(metric: str) -> Column:
    """Floor-rank p95 as one aggregate; its buffer holds one count per distinct thousandth."""
    return F.expr(
        f"percentile_disc({_JUST_ABOVE}) within group (order by floor({metric} * 1e3 + 5e-1))"
    ) / MILLI


#: Accuracy of the streaming sketch: some 16 KB a metric at most, exact up to about as many values, rank error below 1 % beyond.
SKETCH_K = 800
#: The sketch takes element ceil(p n), and takes p n for whole when it nearly is: so far above 0.95 that this is the floor rank
#: wherever the sketch is exact.
_SKETCH_RANK = 0.95001


def p95_sketch(metric: str) -> Column:
    """A mergeable sketch of the metric's thousandths, whose size does not follow the number of values."""
    return F.kll_sketch_agg_bigint(to_milli(F.col(metric)), F.lit(SKETCH_K))


def merged_sketch(sketch: str) -> Column:
    return F.kll_merge_agg_bigint(sketch, F.lit(SKETCH_K))


def p95_of_sketch(sketch: str) -> Column:
    """The floor-rank p95, in thousandths, of a sketch's values; null without values."""
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(_SKETCH_RANK)))


def ranges(metrics: Sequence[str]) -> list[Column]:
    """Aggregates that ``with_p95`` starts from: ``<metric>_n`` and, in thousandths, ``_low`` and ``_high``."""
    out = []
    for m in metrics:
        out += [F.count(m).alias(f"{m}_n"), F.min(to_milli(F.col(m))).alias(f"{m}_low"), F.max(to_milli(F.col(m))).alias(f"{m}_high")]
    return out


#: Number of a group: what its counts are keyed by instead of its keys.
GROUP = "__group"
#: Bits of a value's distance from the low end of its bucket; above them stands the metric's place.
_DISTANCE = 40


def numbered(groups: DataFrame, name: str) -> DataFrame:
    """Groups as a stored table, each with a number that stays."""
    return stored_table(groups.withColumn(GROUP, F.monotonically_increasing_id()), name)


def _counts(rows: DataFrame, groups: DataFrame, keys: Sequence[str], metrics: Sequence[str], codes: Sequence[Column], weight: str | None = None) -> DataFrame:
    """``group, code, n``: how often the rows of a group give each code; ``codes`` has one per metric, null where it does not count.
    A row counts once, or as often as its ``weight`` says."""
    named = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    weights = [weight] if weight else []
    asked = rows.select(*keys, *metrics, *weights).join(named, same).select(GROUP, *weights, F.explode(F.array(*codes)).alias("code"))
    times = F.sum(weight) if weight else F.count(F.lit(1))
    return asked.filter(F.col("code").isNotNull()).groupBy(GROUP, "code").agg(times.alias("n"))


def _is_open(m: str) -> Column:
    """Whether a group's p95 can be other than its maximum."""
    return (F.col(f"{m}_n") > LAST_RANK) & (F.col(f"{m}_high") > F.col(f"{m}_low"))


def coarse_counts(rows: DataFrame, groups: DataFrame, keys: Sequence[str], metrics: Sequence[str], weight: str | None = None) -> DataFrame:
    """Counts per coarse bucket of a group's range, for groups whose p95 is not their maximum; the code is ``BUCKETS`` times the
    metric's place, and the bucket. At most ``BUCKETS`` rows per group and metric leave a task, whatever the group's size."""
    asked = groups.select(GROUP, *keys, *[F.when(_is_open(m), F.col(f"{m}_{c}")).alias(f"{m}_{c}") for m in metrics for c in ("n", "low", "high")])
    sized = asked.select(GROUP, *keys, *[c for m in metrics for c in (f"{m}_low", (F.col(f"{m}_high") - F.col(f"{m}_low") + 1).alias(f"{m}_span"), _buckets(m).alias(f"{m}_buckets"))])
    milli = lambda m: to_milli(F.col(m)) - F.col(f"{m}_low")
    codes = [F.call_function("div", milli(m) * F.col(f"{m}_buckets"), F.col(f"{m}_span")) + i * BUCKETS for i, m in enumerate(metrics)]
    return _counts(rows, sized, keys, metrics, codes, weight)


def _buckets(m: str) -> Column:
    return F.least(F.lit(BUCKETS), F.ceil(F.sqrt(f"{m}_n")))


def _rank_buckets(counts: DataFrame, groups: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per group with such counts, and metric: the values ``from`` and ``to`` between which the floor rank lies, and its ``place`` there."""
    group = Window.partitionBy(GROUP, "metric")
    upto = F.sum("n").over(group.orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("metric", F.expr(f"code div {BUCKETS}"))
    ranked = placed.withColumns({"upto": upto, "total": F.sum("n").over(group)}).withColumn("position", F.expr(_POSITION))
    hit = ranked.filter("upto >= position and upto - n < position").withColumn("place", F.expr("position - upto + n"))
    of = lambda i, c: F.max(F.when(F.col("metric") == i, c))
    chosen = hit.groupBy(GROUP).agg(*[x for i, m in enumerate(metrics) for x in (of(i, F.col("code") % BUCKETS).alias(f"{m}_bucket"), of(i, F.col("place")).alias(f"{m}_place"))])
    ends = []
    for m in metrics:
        span = f"({m}_high - {m}_low + 1)"
        ends.append(F.call_function("div", F.col(f"{m}_bucket") * F.expr(span) + _buckets(m) - 1, _buckets(m)) + F.col(f"{m}_low"))
        ends.append(F.call_function("div", (F.col(f"{m}_bucket") + 1) * F.expr(span) - 1, _buckets(m)) + F.col(f"{m}_low"))
    named = [x for i, m in enumerate(metrics) for x in (ends[2 * i].alias(f"{m}_from"), ends[2 * i + 1].alias(f"{m}_to"), f"{m}_place")]
    return groups.join(chosen, GROUP).select(GROUP, *keys, *named)


def fine_counts(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], metrics: Sequence[str], weight: str | None = None) -> DataFrame:
    """Counts per value of a group's one bucket, where that holds more than one; the code is the metric's place and the value's
    distance from the bucket's low end."""
    codes = []
    for i, m in enumerate(metrics):
        milli = to_milli(F.col(m))
        inside = (F.col(f"{m}_from") < F.col(f"{m}_to")) & milli.between(F.col(f"{m}_from"), F.col(f"{m}_to"))
        codes.append(F.when(inside, milli - F.col(f"{m}_from") + (i << _DISTANCE)))
    return _counts(rows, chosen, keys, metrics, codes, weight)


def _values(counts: DataFrame, chosen: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per group, each metric's value at its place among the counted ones."""
    metric = F.shiftright("code", _DISTANCE).cast("int")
    group = Window.partitionBy(GROUP, "metric").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("metric", metric).withColumn("upto", F.sum("n").over(group))
    at = lambda c: F.get(F.array(*[F.col(f"{m}_{c}") for m in metrics]), F.col("metric"))
    hit = ranked.join(chosen, GROUP).filter((F.col("upto") >= at("place")) & (F.col("upto") - F.col("n") < at("place")))
    value = F.col("code") - F.shiftleft(F.col("metric").cast("long"), _DISTANCE) + at("from")
    return hit.groupBy(GROUP).agg(*[F.max(F.when(F.col("metric") == i, value)).alias(f"{m}_value") for i, m in enumerate(metrics)])


def with_p95(groups: DataFrame, rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = FEATURES, suffix: str = "_p95", weight: str | None = None) -> DataFrame:
    """Adds each metric's exact p95, in thousandths and null without values, to a ``numbered`` table of ``groups``.

    ``groups`` has the keys and the ``ranges`` of ``rows``; a row with a ``weight`` stands for so many. The rows are read twice more, and not at all where every p95 is a
    maximum; they meet the groups by a broadcast where that table is small, else by a shuffle in which adaptive execution splits
    hot groups. Counts are merged before they are shuffled, and keyed by the groups' numbers.
    """
    own = [c for c in groups.columns if c != GROUP]
    open_ = groups.filter(reduce(or_, [_is_open(m) for m in metrics]))
    if not open_.limit(1).count():
        return groups.select(*own, *[F.col(f"{m}_high").alias(m + suffix) for m in metrics])
    chosen = stored_table(_rank_buckets(coarse_counts(rows, open_, keys, metrics, weight), open_, keys, metrics), "rank-buckets")
    unsettled = chosen.filter(reduce(or_, [F.col(f"{m}_from") < F.col(f"{m}_to") for m in metrics]))
    values = _values(fine_counts(rows, unsettled, keys, metrics, weight), unsettled, metrics)
    found = groups.join(chosen.select(GROUP, *[f"{m}_from" for m in metrics]), GROUP, "left").join(values, GROUP, "left")
    return found.select(*own, *[F.coalesce(f"{m}_value", f"{m}_from", f"{m}_high").alias(m + suffix) for m in metrics])


def p95_per_group(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = FEATURES, suffix: str = "_p95"
) -> DataFrame:
    """Exact p95 of each metric per group, for groups of any size; null without values."""
    found = with_p95(numbered(df.groupBy(*keys).agg(*ranges(metrics)), "ranges"), df, keys, metrics, suffix)
    return found.select(*keys, *[(F.col(m + suffix) / MILLI).alias(m + suffix) for m in metrics])


def p95_approx_per_group(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str] = FEATURES,
    accuracy: int = 10_000,
    suffix: str = "_p95",
) -> DataFrame:
    """p95 by a mergeable sketch: one shuffle of small sketches, rank error at most n / accuracy."""
    sketches = [F.percentile_approx(m, 0.95, accuracy).alias(m + suffix) for m in metrics]
    return df.groupBy(*keys).agg(*sketches)
