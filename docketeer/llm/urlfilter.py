"""URL lists over time: which entries of dated lists were active when each page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
MOST_LABELS = 127  # of a host name, by the rules of DNS


def host(url: Column) -> Column:
    """The lower-case host of a URL; empty if it has none."""
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def location(url: Column) -> Column:
    """Host, path and query: a URL without scheme, user, port and fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(host(url), rest)


def domains(name: Column) -> Column:
    """The host and its parent domains: what ``domain`` entries are looked up by."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    starts = F.sequence(F.greatest(F.lit(1), n - MOST_LABELS + 1), n)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def lookups(captures: DataFrame) -> DataFrame:
    """A row for each entry key that could apply to a capture: ``capture``, ``at``, ``kind``, ``key``."""
    of_domain = F.transform(domains(host(F.col("url"))), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("key")))
    of_url = F.array(F.struct(F.lit("url").alias("kind"), location(F.col("url")).alias("key")))
    return captures.where("url IS NOT NULL AND at IS NOT NULL").select("capture", "at", F.explode(F.concat(of_domain, of_url)).alias("k")).select("capture", "at", "k.kind", "k.key")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of the entries: ``list``, ``kind``, ``key``, ``valid_from``, ``valid_to`` (exclusive; null: still valid).

    ``entries``: list, kind (domain or url), key, action (add or remove), at. An entry holds from its addition until the
    next dated entry of its key; of entries of the same moment a removal wins. Rows with a null in any column are left out.
    """
    told = entries.dropna(subset=["list", "kind", "key", "action", "at"])
    told = told.groupBy("list", "kind", "key", "at").agg(F.max("action").alias("action"))  # 'remove' is after 'add'
    w = Window.partitionBy("list", "kind", "key").orderBy("at")
    return told.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'").select("list", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


def active(captures: DataFrame, entries: DataFrame, days: int = 32, most_hot: int = 1000) -> DataFrame:
    """``capture``, ``list``, ``kind``, ``key``: the entries active at each capture's moment.

    ``captures``: capture, url, at. Both sides meet by key and period of ``days`` days, so a key's long history is never
    compared with all its captures. A key with over 1/``most_hot`` of the lookups is salted: its captures are dealt out, its
    intervals copied to each part. There are fewer than ``most_hot`` such keys, so their list is broadcast.
    """
    period = lambda at: F.floor(F.unix_timestamp(at.cast("timestamp")) / (86_400 * days))
    asked = lookups(captures).withColumn("period", period(F.col("at")))
    span = asked.agg(F.count("*").alias("n"), F.max("period").alias("last"), F.min("period").alias("first")).first()
    least = max(10_000, (span.n or 0) // most_hot)
    hot = asked.groupBy("kind", "key").count().where(F.col("count") > least).select("kind", "key", F.ceil(F.col("count") / least).cast("int").alias("parts"))
    hot = F.broadcast(hot)
    first, last = F.lit(span.first or 0), F.lit(span.last or 0)
    held = intervals(entries)
    held = held.withColumns({"from_period": F.greatest(period(F.col("valid_from")), first), "to_period": F.least(F.coalesce(period(F.col("valid_to")), last), last)})
    held = held.where("from_period <= to_period").withColumn("period", F.explode(F.sequence("from_period", "to_period"))).join(hot, ["kind", "key"], "left")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts", "from_period", "to_period")
    asked = asked.join(hot, ["kind", "key"], "left").withColumn("part", F.pmod(F.xxhash64("capture", "at"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    met = asked.join(held, ["kind", "key", "period", "part"])
    return met.where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))).select("capture", "list", "kind", "key").distinct()


def judge(captures: DataFrame, entries: DataFrame, **options: int) -> DataFrame:
    """Every capture with ``blocked``, ``lists`` (names in order, comma-joined; empty if none) and ``n_entries``.

    A capture with a null URL, moment or id, or a URL without a host, is on no list of domains. Repeated captures of one id
    share a verdict by id and moment taken together: an entry that any of them meets counts for all. Columns of the input with the
    names of the verdict are replaced.
    """
    captures = captures.drop("blocked", "lists", "n_entries")
    found = active(captures.where("capture IS NOT NULL"), entries, **options)
    found = found.groupBy("capture").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n_entries"))
    all_of = captures.join(found, "capture", "left")
    return all_of.select(*captures.columns, F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))
