"""What depends on order: jobs, sessions, history, cause lists, contexts with a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job limits, and the budget of assembled contexts.
KEPT_TERMINAL, TIMEOUT_SECONDS = 200, 1800
CONTEXT_CHARS, LEAST_PARTIAL = 80_000, 200
TERMINAL = ("completed", "failed")


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job (job_id, ts, event_id, status): pending, processing, completed or failed.

    A job that still runs after half an hour, by the newest event of all, has failed.
    """
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    jobs = events.groupBy("job_id").agg(F.min("ts").alias("created_at"), last.alias("last"), F.count("*").alias("n_events"))
    now = events.agg(F.max("ts")).scalar()
    late = (F.col("last.status") == "processing") & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp")) > TIMEOUT_SECONDS)
    status = F.when(late, "failed").otherwise(F.col("last.status"))
    return jobs.select("job_id", "created_at", status.alias("status"), F.when(status.isin(*TERMINAL), F.col("last.ts")).alias("completed_at"), "n_events")


def page_of(jobs: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the newest jobs, with the number of all."""
    total = jobs.agg(F.count("*")).scalar()
    return jobs.orderBy(F.desc("created_at"), "job_id").offset(offset).limit(limit).withColumn("total", total)


def evicted(jobs: DataFrame, keep: int = KEPT_TERMINAL) -> DataFrame:
    """The jobs that stay: all that run, and the newest ``keep`` that ended."""
    ended = jobs.where(F.col("status").isin(*TERMINAL))
    newest = ended.orderBy(F.desc(F.coalesce("completed_at", "created_at")), "job_id").limit(keep)
    return jobs.where(~F.col("status").isin(*TERMINAL)).unionByName(newest)


def forward_filled(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each column carries its last value on within a group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def paired(rows: DataFrame, group: str, order: str, starts: Column, other: Column) -> DataFrame:
    """Each starting row with the ``other`` row that follows it before the next start."""
    w = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumns({"entry": F.sum(F.when(starts, 1).otherwise(0)).over(w), "__start": starts, "__other": other}).where("entry > 0")
    first = F.min(F.when(F.col("__start"), F.col(order)))
    return numbered.groupBy(group, "entry").agg(first.alias("petitioner_row"), F.min(F.when(F.col("__other"), F.col(order))).alias("respondent_row"))


def history(messages: DataFrame) -> DataFrame:
    """Turns without system messages; an assistant's turn carries the tool results up to the next one.

    ``messages``: thread, seq, role, text.
    """
    w = Window.partitionBy("thread").orderBy("seq")
    rows = messages.where("role <> 'system'").withColumn("turn", F.sum(F.when(F.col("role") != "tool", 1).otherwise(0)).over(w))
    results = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "tool", F.struct("seq", "text")))), lambda r: r["text"])
    heads = F.first(F.when(F.col("role") != "tool", F.struct("role", "text")), ignorenulls=True)
    out = rows.where("turn > 0").groupBy("thread", "turn").agg(heads.alias("head"), F.array_join(results, "\n").alias("results"), F.count("*").alias("n"))
    return out.select("thread", "turn", "head.role", "head.text", "results", "n")


def around(rows: DataFrame, group: str, order: str, text: str, n: int = 3) -> DataFrame:
    """The n texts before and after each, in order."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.array_join(F.collect_list(text).over(w.rowsBetween(-n, -1)), "\n")
    after = F.array_join(F.collect_list(text).over(w.rowsBetween(1, n)), "\n")
    return rows.withColumns({"before": before, "after": after})


def budgeted(files: DataFrame, group: str, order: str, text: str, budget: int = CONTEXT_CHARS, least: int = LEAST_PARTIAL) -> DataFrame:
    """The text that each file gives to a context of so many characters.

    Files are taken in order. The first that doesn't fit gives what room there is, if over ``least``; none follow it.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    room = F.lit(budget) - F.col("__used")
    rows = files.withColumn("__used", used)
    taken = F.when(F.length(text) <= room, F.col(text)).when(room > least, F.left(text, room.cast("int")))
    return rows.withColumn("taken", taken).where("taken IS NOT NULL").drop("__used")


def islands(rows: DataFrame, group: str, order: str, kind: Column) -> DataFrame:
    """Runs of neighbouring rows of one kind, numbered within the group."""
    w = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumn("kind", kind)
    change = F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1)
    rows = rows.withColumn("__change", change)
    return rows.withColumn("run", F.sum("__change").over(w)).drop("__change")


def first_mentions(rows: DataFrame, group: str, term: str, order: list[str]) -> DataFrame:
    """Whether each mention of a term is its first in the group."""
    w = Window.partitionBy(group, term).orderBy(*order)
    return rows.withColumn("first", F.row_number().over(w) == 1)


def next_hearing(dates: Column, today: str) -> Column:
    """The first listed date (dd-MM-yyyy) after today; what is no date is skipped."""
    parsed = F.transform(dates, lambda d: F.try_to_date(d, "dd-MM-yyyy"))
    return F.get(F.filter(parsed, lambda d: d > F.lit(today).cast("date")), F.lit(0))
