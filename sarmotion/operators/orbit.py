"""Platform position between state vectors, held as an array beside each row or as a table of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

NEIGHBOURS = 4
BEHIND = 2  # vectors before a request that it may need
RANGE_ROWS = 50_000


def _blended(df: DataFrame, when: Column, into: str) -> DataFrame:
    """Lagrange interpolation over the state vectors of ``_near``; one alone is returned as it is, none gives NULL."""

    def weight(own: Column) -> Column:
        def factor(acc: Column, other: Column) -> Column:
            gap = own["t"] - other["t"]
            return F.when(gap == 0, acc).otherwise(acc * (when - other["t"]) / gap)

        return F.aggregate("_near", F.lit(1.0), factor)

    weighted = df.withColumn("_w", F.transform("_near", weight))

    def blend(field: str) -> Column:
        def axis(k: int) -> Column:
            terms = F.zip_with("_w", "_near", lambda w, s: w * s[field][k])
            return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

        return F.array(*[axis(k) for k in range(3)])

    n, single = F.size("_near"), F.get("_near", F.lit(0))
    pick = lambda name, mixed: F.when(n == 1, single[name]).otherwise(mixed).alias(name)
    state = F.struct(
        pick("t", when.cast("double")), pick("pos", blend("pos")), pick("vel", blend("vel"))
    )
    return weighted.withColumn(into, F.when(n > 0, state)).drop("_near", "_w")


def interpolate_orbit(df: DataFrame, states: str, t: str, into: str = "state") -> DataFrame:
    """Add STRUCT<t, pos, vel> by Lagrange interpolation over up to four neighbours.

    ``states`` is an ARRAY of ``(t, pos, vel)`` in time order, at most a few dozen.
    Times outside it extrapolate.  A single vector is returned as it is; an empty
    array gives NULL.
    """
    n, when = F.size(states), F.col(t)
    passed = F.filter(F.slice(states, 1, F.greatest(n - 1, F.lit(1))), lambda s: s["t"] <= when)
    at = F.least(F.size(passed), n - 1)
    start = F.least(F.greatest(at - 1, F.lit(0)), F.greatest(n - 2, F.lit(0)))
    near = df.withColumn("_near", F.slice(states, start + 1, F.least(n - start, F.lit(NEIGHBOURS))))
    return _blended(near, when, into)


def interpolate_orbit_asof(
    requests: DataFrame, states: DataFrame, t: str, keys: Sequence[str] = (), into: str = "state"
) -> DataFrame:
    """The same from a table of state vectors ``(*keys, t, pos, vel)`` of any length, as an as-of join.

    Vectors and requests are sorted together by range, so neither one orbit nor one moment is a hot key, and no pair is
    formed.  Ranges hold RANGE_ROWS rows, so a task's memory does not follow the tables.  What crosses the edge of a range
    travels as rows of their own: the last two vectors before it, the first four after it.  A request keeps its
    columns.  Without a vector of its key its state is NULL; so is one without a time.  Vectors without a time are none.
    """
    keys = list(keys)
    held = [f"_k{i}" for i in range(len(keys))]
    names = dict(zip(held, keys))
    known = states.where(F.col("t").isNotNull()).select(
        *[F.col(k).alias(h) for h, k in names.items()], F.col("t").cast("double").alias("_t"),
        F.struct(F.col("t").cast("double").alias("t"), "pos", "vel").alias("_s"),
    )
    asked = requests.select(
        *[F.col(k).alias(h) for h, k in names.items()], F.col(t).cast("double").alias("_t"),
        F.struct(*requests.columns).alias("_r"), F.monotonically_increasing_id().alias("_n"),
    )
    both = known.unionByName(asked, allowMissingColumns=True)
    ranges = max(1, -(-(known.count() + asked.count()) // RANGE_ROWS))
    # A vector comes before the requests of its moment; equal requests are dealt apart by their number.
    ranged = cut_lineage(both.repartitionByRange(
        ranges, *held, "_t", F.col("_n").asc_nulls_first(), "_s").withColumn("_part", F.spark_partition_id()))
    group = [*held, "_part"]
    edges = _range_edges(ranged, held, ranges)
    crossing = edges.select(*group, F.explode(F.concat("_prior", "_after")).alias("_s")).withColumn("_t", F.col("_s.t"))
    stream = ranged.unionByName(crossing, allowMissingColumns=True).repartition(ranges, *group)
    along = f"partition by {', '.join(group)} order by _t, _n nulls first, _s"
    near = lambda way, k: F.expr(f"{way}(_s, {k}) ignore nulls over ({along})")
    ahead = [f"_f{k}" for k in range(1, NEIGHBOURS + 1)]
    found = stream.withColumns(
        {"_b1": near("lag", 1), "_b2": near("lag", 2), **{c: near("lead", k) for k, c in enumerate(ahead, 1)}}
    ).where("_r is not null")
    last, before, following = F.col("_b1"), F.col("_b2"), [F.col(c) for c in ahead]
    # Before the first vector the first four; the last vector of all is used with the one before it.
    chosen = F.when(last.isNull(), F.array(*following)).when(
        following[0].isNull(), F.array(before, last)).otherwise(F.array(last, *following[:-1]))
    placed = found.withColumn("_near", F.when(F.col("_t").isNotNull(), F.array_compact(chosen)))
    return _blended(placed.select("_r", "_t", "_near"), F.col("_t"), into).select("_r.*", into)


def _range_edges(ranged: DataFrame, held: Sequence[str], ranges: int) -> DataFrame:
    """For every range and key the vectors outside the range that its requests may need: one row each."""
    group = [*held, "_part"]
    vectors = ranged.where("_s is not null").select(*group, "_t", "_s").repartition(ranges, *group)
    along = Window.partitionBy(*group).orderBy("_t", "_s")
    local = vectors.withColumns({"_place": F.row_number().over(along), "_later": F.lead("_t", BEHIND).over(along)})
    ends = local.where((F.col("_place") <= NEIGHBOURS) | F.col("_later").isNull()).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("_place", "_s", F.col("_later").isNull().alias("_end")))).alias("_all"))
    own = ends.select(
        *group, F.filter("_all", lambda x: x["_place"] <= NEIGHBOURS)["_s"].alias("_first"),
        F.filter("_all", lambda x: x["_end"])["_s"].alias("_last"))
    order = Window.partitionBy(*held).orderBy("_part")
    # A range that holds vectors of a key has one at least, so so many ranges are enough on either side.
    onwards = F.flatten(F.collect_list("_first").over(order.rowsBetween(0, NEIGHBOURS - 1)))
    so_far = F.flatten(F.collect_list("_last").over(order.rowsBetween(1 - BEHIND, 0)))
    reach = own.select(
        *group, F.slice(onwards, 1, NEIGHBOURS).alias("_onwards"),
        F.slice(so_far, F.greatest(F.size(so_far) - BEHIND + 1, F.lit(1)), BEHIND).alias("_so_far"))
    present = ranged.select(*group).distinct().unionByName(reach, allowMissingColumns=True).groupBy(*group).agg(
        F.first("_onwards", ignorenulls=True).alias("_onwards"), F.first("_so_far", ignorenulls=True).alias("_so_far"))
    none = F.array().cast(reach.schema["_onwards"].dataType)
    return present.select(
        *group,
        F.coalesce(F.last("_so_far", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), none).alias("_prior"),
        F.coalesce(F.first("_onwards", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), none).alias("_after"),
    )
