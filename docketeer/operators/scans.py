"""Running values over groups of any size: parts of a sorted table are scanned side by side, and what an earlier part carries is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docketeer.operators.ordered import CONTEXT_CHARS, LEAST_PARTIAL
from docketeer.sources.shared import kept

PART = "__part"


def laid(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows in ranges of group and order, written with the number of their range in ``__part``: a large group is in several ranges.

    They are written since the bounds of ranges are drawn from a sample, anew for every job.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    return kept(ranged.withColumn(PART, F.spark_partition_id()))


def carries(table: DataFrame, group: str, last: dict[str, Column], combined: dict[str, Column]) -> DataFrame:
    """What each part's first group brings along from the parts before it: one row for each part.

    ``last`` has aggregates of the rows of one part and group, of which each part's last group counts; ``combined`` makes of these, over the
    window ``before``, those of all parts up to one that end with the same group. Both are keyed by name.
    """
    own = table.groupBy(PART, group).agg(*[c.alias(n) for n, c in last.items()])
    name = F.struct(F.col(group))  # in a struct, a null is a group like any other
    ends = own.groupBy(PART).agg(F.min(name).alias("first"), F.max(name).alias("last"), F.max_by(F.struct(*last), name).alias("v")).select(PART, "first", "last", "v.*")
    ends = ends.select(PART, "first", "last", *[c.alias(n) for n, c in combined.items()])
    # a row for each part, so these few rows need no more than one task
    order = Window.orderBy(PART)
    same = F.lag("last").over(order).eqNullSafe(F.col("first"))
    return ends.select(PART, F.col("first").getField(group).alias("__group"), *[F.when(same, F.lag(n).over(order)).alias(f"__{n}") for n in combined])


def up_to() -> WindowSpec:
    """The parts up to one that end with the same group."""
    return Window.partitionBy("last").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)


def with_carries(table: DataFrame, group: str, brought: DataFrame) -> DataFrame:
    """The rows with what their part's first group brings along; null elsewhere. The parts, a row each, are broadcast."""
    joined = table.join(F.broadcast(brought), PART, "left")
    own = F.col("__group").eqNullSafe(F.col(group))
    return joined.withColumns({c: F.when(own, F.col(c)) for c in brought.columns if c not in (PART, "__group")}).drop("__group")


def local(group: str, order: list[str]) -> WindowSpec:
    return Window.partitionBy(PART, group).orderBy(*order)


def forward_filled(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each column carries its last value on within a group, whatever the group's size: no task has more than a range of it.

    ``order`` must tell the rows of a group apart. Rows without a group are one group.
    """
    table = laid(rows, group, order)
    spot = F.struct(*order)
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), spot)) for c in columns}
    brought = carries(table, group, last, {c: F.last(c, ignorenulls=True).over(up_to()) for c in columns})
    filled = with_carries(table, group, brought)
    here = local(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"__{c}")) for c in columns}).drop(PART, *[f"__{c}" for c in columns])


def running_total(rows: DataFrame, group: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of an amount over the rows before each one in its group; groups of any size, as above. Null amounts count as nothing."""
    table = laid(rows.withColumn("__amount", F.coalesce(amount, F.lit(0)).cast("long")), group, order)
    brought = carries(table, group, {"total": F.sum("__amount")}, {"total": F.sum("total").over(up_to())})
    here = local(group, order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("__amount").over(here), F.lit(0)) + F.coalesce("__total", F.lit(0))
    return with_carries(table, group, brought).withColumn(name, total).drop(PART, "__total", "__amount")


def budgeted(files: DataFrame, group: str, order: list[str], text: str, budget: int = CONTEXT_CHARS, least: int = LEAST_PARTIAL) -> DataFrame:
    """The text that each file gives to its group's context of so many characters, as ``ordered.budgeted``, for groups of any size."""
    rows = running_total(files, group, order, F.length(text), "__used")
    room = F.lit(budget) - F.col("__used")
    taken = F.when(F.length(text) <= room, F.col(text)).when(room > least, F.left(text, room.cast("int")))
    return rows.withColumn("taken", taken).where("taken IS NOT NULL").drop("__used")


def paired(rows: DataFrame, group: str, order: str, starts: Column, other: Column) -> DataFrame:
    """Each starting row with the ``other`` row that follows it before the next start, as ``ordered.paired``, for groups of any size."""
    begins = F.coalesce(starts, F.lit(False))
    numbered = running_total(rows.withColumns({"__start": begins, "__other": F.coalesce(other, F.lit(False))}), group, [order], begins.cast("int"), "entry")
    numbered = numbered.withColumn("entry", F.col("entry") + F.col("__start").cast("int")).where("entry > 0")
    first = F.min(F.when(F.col("__start"), F.col(order)))
    return numbered.groupBy(group, "entry").agg(first.alias("petitioner_row"), F.min(F.when(F.col("__other"), F.col(order))).alias("respondent_row"))
