"""Ordered analytics whose tasks stay bounded when one key, or no key, holds most rows.

A plain window sends a whole partition key to one task.  The helpers here cut the order
axis into buckets at approximate quantiles, run the window inside (key, bucket), and carry
the totals of earlier buckets forward through a table of at most keys x buckets rows.
Bucket limits only steer the distribution of work: results are exact for any limits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.session import cut_lineage

_HOT_PARTS = 64


def _fan_out(df: DataFrame) -> int:
    """Square root of the bucket count, from the session's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, min(64, math.ceil(math.sqrt(width))))


def numeric_order(df: DataFrame, name: str) -> Column:
    """A numeric image of a column that keeps its order (numbers, dates, instants, first bytes of texts)."""
    kind = df.schema[name].dataType.typeName()
    column = F.col(name)
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def with_order_bucket(df: DataFrame, axis: Column, name: str = "__bucket") -> DataFrame:
    """Add a bucket number that never decreases with `axis`; nulls share bucket -1.

    A value that is itself a bucket limit (a heavily repeated value always is one) gets a
    bucket of its own, so ties can be split further by a second axis.
    """
    side = _fan_out(df)
    cuts = side * side
    found = df.agg(F.percentile_approx(axis, [i / cuts for i in range(1, cuts)], 20 * cuts).alias("fine"))
    every = F.filter("fine", lambda _, i: (i + 1) % side == 0)
    limits = found.select(F.struct("fine", every.alias("coarse"))).scalar()
    # A row looks at every side-th limit, then at the one stretch of `side` limits that it falls into.
    below_axis = lambda part: F.size(F.filter(part, lambda limit: limit < F.col("__axis")))
    staged = df.withColumn("__axis", axis).withColumn("__limits", limits)
    staged = staged.withColumn("__coarse", F.greatest(below_axis(F.col("__limits.coarse")), F.lit(0)))
    stretch = F.slice(F.col("__limits.fine"), F.col("__coarse") * side + 1, side)
    staged = staged.withColumn("__below", F.col("__coarse") * side + below_axis(stretch))
    at_limit = F.coalesce(F.get(F.col("__limits.fine"), F.col("__below")) == F.col("__axis"), F.lit(False))
    bucket = F.when(F.col("__axis").isNull() | F.col("__limits.fine").isNull(), F.lit(-1)).otherwise(
        2 * F.col("__below") + at_limit.cast("int")
    )
    return staged.withColumn(name, bucket).drop("__axis", "__limits", "__coarse", "__below")


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    axis: Column,
    order: list[Column],
    measures: dict[str, Column],
    tie_axis: Column | None = None,
) -> DataFrame:
    """Running sums (current row included) per key, with `order` a total order led by `axis`.

    `tie_axis` is a numeric image of the second order column; it splits buckets that hold
    one heavily repeated value of `axis`.  Rows and bucket totals are computed apart, so
    `axis` must be reproducible: write out averages of doubles (`cut_lineage`) first.  A row
    whose bucket has no total stops the job instead of receiving a wrong sum.
    """
    parts = list(keys) + ["__bucket"]
    placed = with_order_bucket(df, axis)
    if tie_axis is not None:
        placed = with_order_bucket(placed, tie_axis, "__tie")
        placed = placed.withColumn("__tie", F.when(F.col("__bucket") % 2 == 1, F.col("__tie")).otherwise(0))
        parts.append("__tie")
    for name, value in measures.items():
        placed = placed.withColumn(f"__m_{name}", value)
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed
    for name in measures:
        local = local.withColumn(f"__c_{name}", F.sum(f"__m_{name}").over(inside))
    totals = placed.groupBy(*parts).agg(*[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures])
    # At most one row per key and bucket: this window is bounded by the bucket count.
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*parts[len(keys):])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(p).alias(f"__o_{p}") for p in parts],
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__p_{n}") for n in measures],
    )
    condition = reduce(
        lambda a, b: a & b,
        [F.col(p).eqNullSafe(F.col(f"__o_{p}")) for p in keys] + [F.col(p) == F.col(f"__o_{p}") for p in parts[len(keys):]],
    )
    joined = local.join(offsets, condition, "left")
    for name in measures:
        carried = F.coalesce(F.col(f"__p_{name}"), F.raise_error("running_sums: order axis is not reproducible").cast("bigint"))
        joined = joined.withColumn(name, F.coalesce(F.col(f"__c_{name}"), F.lit(0)) + carried)
    dropped = [c for c in joined.columns if c.startswith(("__m_", "__c_", "__p_", "__o_"))]
    return joined.drop(*dropped, "__bucket", "__tie")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on named keys in which nulls are equal, as they are in grouping."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__k_{k}" for k in keys])


def unique_rank(
    df: DataFrame,
    score: str,
    tie: str,
    name: str = "rank",
    keys: list[str] | None = None,
    descending: bool = True,
) -> DataFrame:
    """1..n by score with the id as tie-break; a missing score is left unranked."""
    keys = keys or []
    sign = -1 if descending else 1
    scored = df.filter(F.col(score).isNotNull())
    ordering = [F.col(score).desc() if descending else F.col(score).asc(), F.col(tie).asc()]
    ranked = running_sums(
        scored,
        keys,
        numeric_order(scored, score) * sign,
        ordering,
        {name: F.lit(1).cast("bigint")},
        numeric_order(scored, tie),
    )
    missing = df.filter(F.col(score).isNull()).withColumn(name, F.lit(None).cast("bigint"))
    return ranked.unionByName(missing)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per key and distinct value, written once: limits, sums and totals all read them."""
    return cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("peers")))


def value_positions(df: DataFrame, keys: list[str], value: str, counted: DataFrame | None = None) -> DataFrame:
    """One row per key and distinct value: its count, and how many rows lie below it."""
    counted = value_counts(df, keys, value) if counted is None else counted
    placed = running_sums(
        counted, keys, numeric_order(counted, value), [F.col(value).asc()], {"through": F.col("peers")}
    )
    return placed.withColumn("below", F.col("through") - F.col("peers"))


def lookup_by_value(df: DataFrame, table: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """Left join to a table unique on `keys` that carries the row count `peers` of each key.

    Keys with more than 1/64 of all rows number fewer than 64; their table rows are
    broadcast and their detail rows never shuffle.  Every other key joins by shuffle.
    """
    total = table.agg(F.sum("peers")).scalar()
    flagged = table.withColumn("__all", total).withColumn("__hot", F.col("peers") * _HOT_PARTS > F.col("__all"))
    small = [F.col(k).alias(f"__k_{k}") for k in keys]
    hot = flagged.filter("__hot").select(*small, *[F.col(c).alias(f"__h_{c}") for c in carried], F.lit(True).alias("__is_hot"))
    cold = flagged.filter(~F.col("__hot")).select(*keys, *carried)
    on_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    marked = df.join(F.broadcast(hot), on_hot, "left").drop(*[f"__k_{k}" for k in keys])
    done = marked.filter("__is_hot").drop("__is_hot")
    for c in carried:
        done = done.withColumnRenamed(f"__h_{c}", c)
    rest = marked.filter(F.col("__is_hot").isNull()).drop("__is_hot", *[f"__h_{c}" for c in carried])
    return done.unionByName(join_null_safe(rest, cold, keys, "left"))


def average_rank_shares(
    df: DataFrame, ids: list[str], columns: dict[str, tuple[str, bool]], keys: list[str] | None = None
) -> DataFrame:
    """Average rank of each value divided by the number of present values; null stays null.

    `columns` maps an output name to (source column, ascending); `ids` identify a row and
    include `keys`.  All columns are ranked together in long form, so the plan grows with
    their number only once.  Ties share the mean of their ranks, and values are counted
    before any ordering, so a value held by a third of the rows costs one counted row.
    """
    keys = keys or []
    options = F.array(*[F.struct(F.lit(n).alias("m"), F.col(c).cast("double").alias("v")) for n, (c, _) in columns.items()])
    long = df.select(*ids, F.explode(options).alias("__x")).select(*ids, F.col("__x.m").alias("__metric"), F.col("__x.v").alias("__value"))
    long = long.filter(F.col("__value").isNotNull())
    group = [*keys, "__metric"]
    counted = value_counts(long, group, "__value")
    sizes = counted.groupBy(*group).agg(F.sum("peers").alias("__n"))
    spots = join_null_safe(value_positions(long, group, "__value", counted), sizes, group)
    spots = spots.withColumn("__rank", F.col("below") + (F.col("peers") + 1) / 2)
    placed = lookup_by_value(long, spots.select(*group, "__value", "peers", "__rank", "__n"), [*group, "__value"], ["__rank", "__n"])
    shares = []
    for name, (_, ascending) in columns.items():
        rank = F.col("__rank") if ascending else F.col("__n") + 1 - F.col("__rank")
        shares.append(F.max(F.when(F.col("__metric") == name, rank / F.col("__n"))).alias(name))
    return join_null_safe(df, placed.groupBy(*ids).agg(*shares), ids, "left")


def average_rank_share(df: DataFrame, value: str, names: dict[str, bool]) -> DataFrame:
    """Rank shares of one column over the whole table, joined by value: rows need no id.

    `names` maps each output to its direction (True for ascending).
    """
    spots = value_positions(df, [], value).withColumn("__n", df.agg(F.count(value)).scalar())
    up = F.col("below") + (F.col("peers") + 1) / 2
    shares = [((up if ascending else F.col("__n") + 1 - up) / F.col("__n")).alias(n) for n, ascending in names.items()]
    return lookup_by_value(df, spots.select(value, "peers", *shares), [value], list(names))


_SKETCH = 10_000  # accuracy of the first guess
_SMALL = 4_096  # keys of so many rows need no guess
_WINDOW = 200_000  # counted values of one key and fraction that one task may order
_FEW_KEYS = 4_096  # ranges of so many keys are sent to every task


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], how: str = "linear"
) -> DataFrame:
    """Exact quantiles per key: a sketch narrows the value range, only the rows inside it are counted and ordered.

    `how` is "linear" (interpolated between neighbours) or "higher" (the next observation).  A sketch per
    key bounds each quantile from both sides, three times wider than its error.  Rows below the range are
    counted, rows inside it are counted by value, and the ranks are looked up there; keys of few rows are
    inside as a whole.  What is inside is split by order buckets if it is more than a task should order.
    Rows meet the ranges without being sorted by key: ranges of few keys are broadcast, otherwise those of hot
    keys are, so no task holds the rows of a busy key.  A range that missed its rank would stop the job instead of giving a wrong value.
    """
    own, names = keys or ["__all"], list(fractions)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, *([] if keys else [F.lit(1).alias("__all")]), F.col(value).cast("double").alias("__v"))
    wide = 3 / _SKETCH
    shares = [max(0.0, f - wide) for f in fractions.values()] + [min(1.0, f + wide) for f in fractions.values()]
    stats = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", shares, _SKETCH).alias("__p"))
    ranges = []
    for k, f in enumerate(fractions.values()):
        low = F.col("__max") if f >= 1 else F.col("__min") if f <= wide else F.col("__p")[k]
        high = F.col("__min") if f <= 0 else F.col("__max") if f >= 1 - wide else F.col("__p")[len(names) + k]
        ranges.append(F.struct(F.lit(k).alias("tag"), low.alias("lo"), high.alias("hi")))
    whole = F.array(F.struct(F.lit(-1).alias("tag"), F.col("__min").alias("lo"), F.col("__max").alias("hi")))
    ranges = cut_lineage(stats.select(*own, "n", F.when(F.col("n") <= _SMALL, whole).otherwise(F.array(*ranges)).alias("__r")))

    if ranges.count() <= _FEW_KEYS:
        met = join_null_safe(rows, F.broadcast(ranges), own)
    else:
        met = lookup_by_value(rows, ranges.withColumn("peers", F.col("n")), own, ["n", "__r"])
    inside = met.select(*own, "__v", F.explode(F.filter("__r", lambda r: (F.col("__v") >= r["lo"]) & (F.col("__v") <= r["hi"]))["tag"]).alias("__tag"))
    counted = cut_lineage(inside.groupBy(*own, "__tag", "__v").agg(F.count(F.lit(1)).alias("peers")))
    most = counted.groupBy(*own, "__tag").count().agg(F.max("count")).first()[0] or 0
    part = [*own, "__tag"]
    if most <= _WINDOW:
        through = F.sum("peers").over(Window.partitionBy(*part).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumn("through", through)
    else:
        placed = running_sums(counted, part, F.col("__v"), [F.col("__v").asc()], {"through": F.col("peers")})
    less = lambda k: F.sum((F.col("__v") < F.get(F.col("__r"), k)["lo"]).cast("bigint"))
    below = met.filter(F.col("n") > _SMALL).groupBy(*own).agg(F.array(*[less(k) for k in range(len(names))]).alias("__less"))
    placed = join_null_safe(join_null_safe(placed, ranges.select(*own, "n"), own), below, own, "left")
    placed = placed.withColumn("through", F.col("through") + F.coalesce(F.when(F.col("__tag") >= 0, F.get("__less", F.col("__tag"))), F.lit(0)))
    placed = placed.withColumn("below", F.col("through") - F.col("peers"))
    aggregates = []
    for k, (name, fraction) in enumerate(fractions.items()):
        spot = (F.col("n") - 1) * F.lit(float(fraction))
        mine = (F.col("__tag") == k) | (F.col("__tag") == -1)
        covers = lambda p: mine & (F.col("below") <= p) & (p < F.col("through"))  # noqa: B023, E731
        aggregates += [
            F.max(F.when(covers(F.floor(spot)), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when(covers(F.ceil(spot)), F.col("__v"))).alias(f"__hi_{name}"),
        ]
    picked = placed.groupBy(*own).agg(F.max("n").alias("n"), *aggregates)
    outputs = []
    for name, fraction in fractions.items():
        spot = (F.col("n") - 1) * F.lit(float(fraction))
        missed = F.raise_error("exact_quantiles: a range missed its rank").cast("double")
        low, high = F.coalesce(f"__lo_{name}", missed), F.coalesce(f"__hi_{name}", missed)
        outputs.append((high if how == "higher" else low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*keys, "n", *outputs)


def prior_rows(
    df: DataFrame,
    keys: list[str],
    axis: Column,
    order: list[Column],
    label: str,
    sizes: list[int],
    prefix: str = "prior",
    tie_axis: Column | None = None,
) -> DataFrame:
    """Count and mean of `label` over the last n rows before each row, current row excluded.

    Rows are numbered per key with carried offsets; the running count and sum at the frame's
    left edge come from an equi-join on (key, row number), a key no two rows share.
    """
    seen = running_sums(
        df,
        keys,
        axis,
        order,
        {
            "__row": F.lit(1).cast("bigint"),
            "__known": F.col(label).isNotNull().cast("bigint"),
            "__sum": F.coalesce(F.col(label), F.lit(0)).cast("bigint"),
        },
        tie_axis,
    )
    out = seen
    for n in sizes:
        edge = seen.select(
            *[F.col(k).alias(f"__e_{k}") for k in keys],
            (F.col("__row") + n + 1).alias("__e_row"),
            F.col("__known").alias(f"__ek_{n}"),
            F.col("__sum").alias(f"__es_{n}"),
        )
        on = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys] + [F.col("__row") == F.col("__e_row")],
        )
        out = out.join(edge, on, "left").drop("__e_row", *[f"__e_{k}" for k in keys])
    before_known = F.col("__known") - F.col(label).isNotNull().cast("bigint")
    before_sum = F.col("__sum") - F.coalesce(F.col(label), F.lit(0)).cast("bigint")
    for n in sizes:
        known = before_known - F.coalesce(F.col(f"__ek_{n}"), F.lit(0))
        total = before_sum - F.coalesce(F.col(f"__es_{n}"), F.lit(0))
        out = out.withColumn(f"{prefix}_{n}_count", F.least(F.col("__row") - 1, F.lit(n).cast("bigint")))
        out = out.withColumn(f"{prefix}_{n}_rate", total / F.when(known > 0, known))
    return out.drop("__row", "__known", "__sum", *[f"__ek_{n}" for n in sizes], *[f"__es_{n}" for n in sizes])


def prior_days(
    df: DataFrame,
    keys: list[str],
    instant: str,
    label: str,
    days: int,
    prefix: str | None = None,
) -> DataFrame:
    """Count and mean of `label` over the `days` days strictly before each row's instant.

    The frame splits into whole days in between (one row per key and day), the part of
    today before the instant, and the part of the oldest day at or after the left edge.
    The parts of a day are running sums carried over order buckets, so a busy key's day is many
    tasks' work; whole days are summed over one row per key and day.
    """
    prefix = prefix or f"prior_{days}d"
    micros_per_day = 86_400_000_000
    staged = df.withColumn("__at", F.unix_micros(F.col(instant).cast("timestamp")))
    counted = staged.groupBy(*keys, "__at").agg(
        F.count("*").cast("bigint").alias("__n"),
        F.count(label).cast("bigint").alias("__known"),
        F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("__sum"),
    )
    zero = F.lit(0).cast("bigint")
    here = counted.select(*keys, "__at", F.col("__at").alias("__probe"), "__n", "__known", "__sum", F.lit("now").alias("__role"))
    edge = counted.select(
        *keys, F.col("__at"), (F.col("__at") - days * micros_per_day).alias("__probe"),
        zero.alias("__n"), zero.alias("__known"), zero.alias("__sum"), F.lit("edge").alias("__role"),
    )
    probes = here.unionByName(edge).withColumn("__day", F.floor(F.col("__probe") / micros_per_day).cast("bigint"))
    parts = ["__n", "__known", "__sum"]
    # Edges count nothing and come before the instant they share; less its own, a sum is that of earlier instants.
    order = [F.col("__probe"), F.col("__role")]
    probes = running_sums(probes, [*keys, "__day"], F.col("__probe").cast("double"), order, {f"{p}_b": F.col(p) for p in parts})
    probes = probes.withColumns({f"{p}_b": F.col(f"{p}_b") - F.col(p) for p in parts})
    pieces = probes.groupBy(*keys, "__at").agg(
        *[F.max(F.when(F.col("__role") == "now", F.col(f"{p}_b"))).alias(f"{p}_now") for p in parts],
        *[F.max(F.when(F.col("__role") == "edge", F.col(f"{p}_b"))).alias(f"{p}_edge") for p in parts],
    ).withColumn("__day", F.floor(F.col("__at") / micros_per_day).cast("bigint"))
    daily = counted.withColumn("__day", F.floor(F.col("__at") / micros_per_day).cast("bigint")).groupBy(*keys, "__day").agg(
        *[F.sum(p).alias(p) for p in parts]
    )
    whole = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-days, -1)
    daily = daily.select(*keys, "__day", *[F.coalesce(F.sum(p).over(whole), F.lit(0)).alias(f"{p}_days") for p in parts])
    joined = join_null_safe(pieces, daily, [*keys, "__day"])
    total = lambda p: F.col(f"{p}_days") + F.col(f"{p}_now") - F.col(f"{p}_edge")
    history = joined.select(
        *keys, "__at",
        total("__n").alias(f"{prefix}_count"),
        (total("__sum") / F.when(total("__known") > 0, total("__known"))).alias(f"{prefix}_rate"),
    )
    return join_null_safe(staged, history, [*keys, "__at"], "left").drop("__at")


def trailing_sums(df: DataFrame, keys: list[str], order: str, measures: dict[str, str], rows: int) -> DataFrame:
    """Sums over the last `rows` pre-aggregated rows, current one included."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.select("*", *[F.sum(source).over(frame).alias(name) for name, source in measures.items()])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the row of each key with the greatest order tuple (missing parts rank lowest).

    Spark applies the limit of one row per key inside every map task before the shuffle
    (WindowGroupLimit), so a key that owns a third of the rows sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") == 1).drop("__k")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", dense: bool = False) -> DataFrame:
    """First k rows per key; Spark limits each group on the map side before shuffling."""
    number = F.dense_rank() if dense else F.row_number()
    return df.withColumn(rank, number.over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
