"""Building blocks that stay exact when one key holds a large share of the rows.

Ranks, running totals and quantiles are computed in two levels: rows are placed in ordered
buckets, buckets are counted with partial aggregation, and only the rows of one bucket are ever
sorted together. No step collects a whole group in one task or on the driver.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tetrarank.functions.numeric import hash_bucket, hash_text, value_bucket


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder named by the cluster in `spark.checkpoint.dir`.

    Only a session on one machine (local[...]) may go without one; it gets a folder of its own, deleted when it ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tetrarank-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet under the shared checkpoint folder, for several passes over them."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_unused(spark: SparkSession) -> None:
    """Let go of what no frame refers to any more: Spark deletes such shuffle files after a garbage collection of the driver only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def dropping_unused(spark: SparkSession, every: float = 5.0) -> Iterator[None]:
    """`drop_unused` every so many seconds while something long runs, whose steps leave shuffle files behind."""
    ended = threading.Event()

    def run() -> None:
        while not ended.wait(every):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
    drop_unused(spark)


#: Rows of a group that may meet in one task; the rows of larger groups are dealt out.
GROUP_ROWS = 100_000


def by_size(df: DataFrame, by: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most `most` rows, rows of the larger groups or None), after one count per group.

    There are fewer large groups than rows / most, so their keys are broadcast.
    """
    checkpoint_dir(df.sparkSession)
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (GROUP_ROWS if most is None else most))
    large = counted.select(*[F.col(c).alias(f"__l_{c}") for c in by]).checkpoint()
    if large.isEmpty():
        return df, None
    same = _same("__l_", by)
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark limits each group to k rows before the shuffle as well as after."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*by, *[F.col("__row")[c].alias(c) for c in rest])


def tie_bucket(df: DataFrame, column: str) -> Column:
    """Ascending bucket of a tie-break column: of its value if numeric, else of its first bytes."""
    if isinstance(df.schema[column].dataType, NumericType):
        return value_bucket(F.col(column).cast("double"), 1.0)
    return F.coalesce(_left_aligned(F.col(column).cast("string").cast("binary"), 6), F.lit(-1).cast("long"))


def _left_aligned(data: Column, size: int) -> Column:
    """The first bytes as one number that ascends with the text, shorter texts filled with zero bytes."""
    return F.conv(F.rpad(F.hex(F.substring(data, 1, size)), 2 * size, "0"), 16, 10).cast("long")


def _sums_before(sums: DataFrame, by: list[str], at: str, names: list[str], reverse: bool) -> DataFrame:
    """__o_*: sums of __s_* over the rows of a group that come before."""
    frame = W.partitionBy(*by).orderBy(F.desc(at) if reverse else F.asc(at)).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumns({f"__o_{n}": F.coalesce(F.sum(f"__s_{n}").over(frame), F.lit(0)) for n in names})


def running_totals(df: DataFrame, by: list[str], order: list[Column], bucket: Column,
                   totals: dict[str, Column], reverse: bool = False, coarse: Column | None = None) -> DataFrame:
    """Inclusive running sums of `totals` per key in the given order.

    `bucket` must ascend (not strictly) with the order. With `reverse` the sums run from each row to
    the end of its group. Where there are too many buckets for one task, `coarse` puts them together in their order.
    """
    names = list(totals)
    work = df.withColumn("__bucket", bucket).withColumns({f"__v_{n}": totals[n] for n in names})
    keys = [*by, "__bucket"]
    if coarse is None:
        per_bucket = work.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
        offsets = _sums_before(per_bucket, by, "__bucket", names, reverse)
    else:
        per_bucket = work.withColumn("__coarse", coarse).groupBy(*keys, "__coarse").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
        upper = _sums_before(per_bucket.groupBy(*by, "__coarse").agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in names]), by, "__coarse", names, reverse)
        upper = upper.select(*[F.col(c).alias(f"__c_{c}") for c in [*by, "__coarse"]], *[F.col(f"__o_{n}").alias(f"__u_{n}") for n in names])
        inner_sums = _sums_before(per_bucket, [*by, "__coarse"], "__bucket", names, reverse)
        offsets = inner_sums.join(upper, _same("__c_", [*by, "__coarse"])).withColumns({f"__o_{n}": F.col(f"__o_{n}") + F.col(f"__u_{n}") for n in names})
    offsets = offsets.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[f"__o_{n}" for n in names])
    inner = W.partitionBy(*keys).orderBy(*order)
    span = (inner.rowsBetween(W.currentRow, W.unboundedFollowing) if reverse
            else inner.rowsBetween(W.unboundedPreceding, W.currentRow))
    for n in names:
        work = work.withColumn(f"__r_{n}", F.sum(f"__v_{n}").over(span))
    return work.join(offsets, _same("__k_", keys)).select(
        *df.columns, *[(F.col(f"__r_{n}") + F.col(f"__o_{n}")).alias(n) for n in names])


def ranked_totals(df: DataFrame, by: list[str], value: str, ties: list[str], totals: dict[str, Column],
                  reverse: bool = False, resolution: float = 256.0) -> DataFrame:
    """Inclusive running sums per key by descending value, ties by the given columns ascending.

    Equal values are one row while sums run over values, and run among themselves in buckets of the first tie
    column; so neither a spread-out nor a constant column, nor one value that most rows share, is sorted in one task.
    """
    names = list(totals)
    work = df.withColumn("__value", F.col(value).cast("double")).withColumns({f"__t_{n}": totals[n] for n in names})
    sums = work.groupBy(*by, "__value").agg(*[F.sum(f"__t_{n}").alias(f"__t_{n}") for n in names])
    over = running_totals(sums, by, [F.desc("__value")], -value_bucket(F.col("__value"), resolution),
                          {f"__x_{n}": F.col(f"__t_{n}") for n in names}, reverse)
    keys = [*by, "__value"]
    apart = over.select(*[F.col(c).alias(f"__u_{c}") for c in keys], *[(F.col(f"__x_{n}") - F.col(f"__t_{n}")).alias(f"__y_{n}") for n in names])
    inside = running_totals(work, keys, [F.col(c) for c in ties], tie_bucket(df, ties[0]), {f"__i_{n}": F.col(f"__t_{n}") for n in names}, reverse)
    return inside.join(apart, _same("__u_", keys)).select(*df.columns, *[(F.col(f"__i_{n}") + F.col(f"__y_{n}")).alias(n) for n in names])


def hash_rank(df: DataFrame, by: list[str], key: list[str], rank: str, seed: str = "42") -> DataFrame:
    """1-based position of each row within its group, in md5 order of the key columns.

    The number of buckets follows the number of rows, so that some thousand rows at most share one; over 65,536 buckets are
    summed in two levels.
    """
    hashed = hash_text(*[F.col(c) for c in key], seed=seed)
    order = [F.col("__hash"), *[F.col(c) for c in key]]
    keys = df.select(*key)
    digits = hash_digits(keys.count() if estimated_bytes(keys) > UNCOUNTED_BYTES else 0)
    out = running_totals(df.withColumn("__hash", hashed), by, order, hash_bucket(F.col("__hash"), digits), {rank: F.lit(1)},
                         coarse=hash_bucket(F.col("__hash")) if digits > 4 else None)
    return out.drop("__hash")


#: Inputs that Spark estimates below this size have far fewer rows than 65,536 buckets can take, and are not counted first.
UNCOUNTED_BYTES = 1 << 30


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a result, from its plan and without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_digits(rows: int, each: int = 4096) -> int:
    """Leading hex digits that deal so many rows to buckets of about `each` rows or fewer; at least four, at most eleven."""
    digits = 4
    while digits < 11 and 16 ** digits * each < rows:
        digits += 1
    return digits


def range_rank(df: DataFrame, by: list[str], order: list[str], rank: str) -> DataFrame:
    """1-based position of each row within its group, by the order columns ascending.

    The rows are dealt to ranges of groups and order, whose borders Spark takes from a sample, and stored; a row's position is that
    in its range after the counts of the group's ranges before. So no group meets in one task, whatever its values look like.
    """
    checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__s_n"))
    before = _sums_before(counts, by, "__range", ["n"], False).select(*[F.col(c).alias(f"__k_{c}") for c in [*by, "__range"]], "__o_n")
    inside = placed.withColumn("__in", F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order)))
    return inside.join(before, _same("__k_", [*by, "__range"])).select(*df.columns, (F.col("__in") + F.col("__o_n")).alias(rank))


def value_rank(df: DataFrame, by: list[str], value: str, ties: list[str], rank: str,
               resolution: float = 256.0) -> DataFrame:
    """1-based position by descending value, ties by the given columns ascending.

    Groups of at most GROUP_ROWS rows are sorted as they are; only larger ones are ranked in buckets.
    """
    if not by:
        return ranked_totals(df, by, value, ties, {rank: F.lit(1)}, resolution=resolution)
    short, large = by_size(stored(df, "ranked"), by)
    order = [F.desc("__value"), *[F.col(c) for c in ties]]
    out = short.withColumn("__value", F.col(value).cast("double")).withColumn(
        rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).drop("__value")
    return out if large is None else out.unionByName(ranked_totals(large, by, value, ties, {rank: F.lit(1)}, resolution=resolution))


def _same(left: str, by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{left}{c}")) for c in by], F.lit(True))


def with_group_stats(df: DataFrame, by: list[str], stats: list[Column]) -> DataFrame:
    """Attach per-group aggregates by aggregate-and-join, which splits hot groups where a window cannot.

    The input is read twice; for candidate lists, whose size retrieval bounds, use `with_list_stats`.
    """
    if not by:
        one = df.agg(*stats)
        return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])
    grouped = df.groupBy(*by).agg(*stats)
    names = [c for c in grouped.columns if c not in by]
    renamed = grouped.select(*[F.col(c).alias(f"__g_{c}") for c in by], *names)
    return df.join(renamed, _same("__g_", by)).drop(*[f"__g_{c}" for c in by])


def with_list_stats(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """Attach per-list aggregates with one window: one shuffle, and none where the rows already lie by list."""
    if not by:
        return with_group_stats(df, by, [c.alias(n) for n, c in stats.items()])
    lists = W.partitionBy(*by)
    return df.select("*", *[c.over(lists).alias(n) for n, c in stats.items()])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    resolution: float = 256.0) -> DataFrame:
    """Exact linear-interpolated quantiles per group without holding a group in memory.

    A first pass counts rows per value bucket and finds the buckets that hold the wanted positions; a
    second pass counts the distinct values of those buckets only and reads the positions off them.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__value"))
    rows = rows.withColumn("__bucket", value_bucket(F.col("__value"), resolution))
    ordered = W.partitionBy(*by).orderBy("__bucket")
    sizes = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        *by, "__bucket", "__n", F.sum("__n").over(ordered).alias("__upto"), F.sum("__n").over(W.partitionBy(*by)).alias("__size"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), edge((F.col("__size") - 1) * F.lit(float(p))).alias("pos"))
        for name, p in probs.items() for side, edge in (("low", F.floor), ("high", F.ceil))]))
    before = F.col("__upto") - F.col("__n")
    targets = sizes.select(
        *[F.col(c).alias(f"__t_{c}") for c in [*by, "__bucket"]], "__size", before.alias("__before"), "__upto", wanted.alias("__w")).where(
        (F.col("__w.pos") >= F.col("__before")) & (F.col("__w.pos") < F.col("__upto"))).select(
        *[f"__t_{c}" for c in [*by, "__bucket"]], "__size", "__before", "__w.*")
    keys = [*by, "__bucket"]
    asked = rows.join(targets.select(*[f"__t_{c}" for c in keys]), _same("__t_", keys), "left_semi")
    counted = asked.groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__c"))
    inside = counted.withColumn("__in", F.sum("__c").over(W.partitionBy(*keys).orderBy("__value")))
    last = F.col("__before") + F.col("__in")
    found = inside.join(targets, _same("__t_", keys)).where((F.col("pos") < last) & (F.col("pos") >= last - F.col("__c")))

    def side_value(name: str, side: str) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("__value")))

    out = []
    for name, p in probs.items():
        position = (F.max("__size") - 1) * F.lit(float(p))
        low, high = side_value(name, "low"), side_value(name, "high")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.groupBy(*by).agg(*out)


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str, resolution: float = 256.0) -> DataFrame:
    """Ascending rank per group where equal values share the mean of their positions."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_totals(counted, by, [F.col(value)], value_bucket(F.col(value).cast("double"), resolution),
                          {"__upto": F.col("__n")})
    ranks = upto.select(*[F.col(c).alias(f"__a_{c}") for c in by], F.col(value).alias("__a_value"),
                        (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)).alias(rank))
    return df.join(ranks, _same("__a_", by) & F.col(value).eqNullSafe(F.col("__a_value"))).drop(
        *[f"__a_{c}" for c in by], "__a_value")
