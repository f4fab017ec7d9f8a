"""I-Match fingerprints: hashes of the terms in a band of inverse document frequency, for several randomised lexicons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketeer.llm.common import discard, let, save

#: Families of lexicons: of how many parts of the terms' hash each takes one, and how many there are.
#: The first is the whole lexicon; sparser ones survive more edits, which long documents need.
FAMILIES = ((1, 1), (16, 8), (128, 16), (1024, 32))
SPARSE = sum(most for _, most in FAMILIES)
DENSE = 8  # further lexicons, each without a third of the terms
MOST_BYTES = 64_000_000  # of a lexicon that is broadcast, at 16 bytes a term


def terms(text: Column) -> Column:
    """The distinct lower-case words (letters and digits) of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, total: int, low: float, high: float) -> DataFrame:
    """``term`` (a hash): the terms whose inverse document frequency, ln(documents / documents with it), is in the band; there are ``total`` documents.

    Each is in a share exp(-high) of the documents at least, so there are at most exp(high) times as many as an average document
    has: a bound that does not grow with the corpus.
    """
    counts = save(docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("term")).agg(F.count("*").alias("n")))
    band = counts.where(F.col("n").between(max(2, math.ceil(total * math.exp(-high))), total * math.exp(-low)))
    kept = save(band.select("term"))
    discard(counts)
    return kept


def named(docs: DataFrame) -> DataFrame:
    """Adds ``h1`` and ``h2``, 128 bits that stand for a row's id and text."""
    return docs.withColumns({"h1": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), "h2": F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text")})


def placed(docs: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``doc_id`` and ``k``, the number of equal rows, for each different row, and who comes ``before`` it in the order of ids, in a circle.

    Null ids come first; rows of one id go by a hash of their text. Texts aren't shuffled: what is ordered, in ranges, is a few numbers a
    row, and equal rows are one. The row before a range's first is the last of the range before, one carry for each range.
    """
    each = docs.select("doc_id", "h1", "h2", F.length("text").alias("n"), F.xxhash64("text").alias("tie")).groupBy("h1", "h2")
    each = each.agg(F.first("doc_id").alias("doc_id"), F.first("tie").alias("tie"), F.first("n").alias("n"), F.count("*").alias("k"))
    order = ["doc_id", "tie", "h1", "h2"]
    laid = each.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = save(laid.select("h1", "h2", "doc_id", "n", "k", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")))
    who = F.struct("rid", "h1", "h2", F.floor(F.col("n") / 4).cast("int").alias("wants"))
    ends = laid.groupBy("part").agg(F.max(who).alias("end"))
    parts = Window.orderBy("part")  # a row for each range
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    brought = ends.select("part", F.coalesce(F.lag("end").over(parts), F.last("end").over(whole)).alias("brought"))
    before = F.coalesce(F.lag(who).over(Window.partitionBy("part").orderBy("rid")), F.col("brought"))
    return laid.join(F.broadcast(brought), "part").select("h1", "h2", "doc_id", "k", before.alias("before"))


def followed(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each different row (``h1``, ``h2``) with as much of the next one's text (``ahead``) as its edit wants, and who comes ``before`` it.

    Of ``k`` equal rows the last (``v`` 1) is followed by the next different one, the others (``v`` 0, one row for all) by their own
    text. The texts are shuffled once, and a quarter of them once more, to the row before. Rows stay dealt by their names, so that what is
    made of their texts is grouped where it is.
    """
    # nothing but the text, so that Spark sees the plans of all readers as the same and shuffles the texts once
    once = docs.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    held = once.join(places, ["h1", "h2"])
    ahead = held.select(F.col("before.h1").alias("h1"), F.col("before.h2").alias("h2"), F.left("text", F.col("before.wants")).alias("ahead"))
    rows = held.join(ahead, ["h1", "h2"])
    last = F.struct(F.lit(1).alias("v"), F.lit(1).cast("long").alias("times"), F.col("ahead"))
    others = F.struct(F.lit(0).alias("v"), (F.col("k") - 1).alias("times"), F.col("text").alias("ahead"))
    variant = F.explode(F.when(F.col("k") > 1, F.array(last, others)).otherwise(F.array(last))).alias("x")
    return rows.select("h1", "h2", "before", "doc_id", "text", variant).select("h1", "h2", "before", "doc_id", "text", "x.v", "x.times", "x.ahead")


def repeated(rows: DataFrame, times: str, most: int = 100_000) -> DataFrame:
    """Each row as often as a column says, in steps of ``most``."""
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times), F.lit(most).cast("long"))))
    return rows.withColumn("__n", F.explode(F.sequence(F.col("__from"), F.least(F.col(times), F.col("__from") + most - 1)))).drop("__from", "__n")


def edited(text: Column, other: Column) -> Column:
    """The text with its last quarter of code points replaced by as many, or all, of the other's first ones."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - n), F.left(other, n))


def subset_hashes(sorted_terms: Column) -> Column:
    """A hash for each randomised lexicon of the sorted terms that are in it; null if none is."""

    def family(number: int, parts: int, most: int) -> Column:
        part = lambda t: F.pmod(F.shiftright(t, 11 * number), F.lit(parts))
        taken = F.filter(sorted_terms, lambda t: part(t) < most) if most < parts else sorted_terms
        one = lambda own: F.when(F.size(own) > 0, F.xxhash64(own))
        return let(taken, lambda some: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: let(F.filter(some, lambda t: part(t) == j), one)))

    dense = F.transform(F.sequence(F.lit(0), F.lit(DENSE - 1)), lambda j: let(F.filter(sorted_terms, lambda t: F.pmod(F.xxhash64(t, j), F.lit(3)) > 0), lambda own: F.when(F.size(own) > 0, F.xxhash64(own))))
    return F.concat(*[family(i, *f) for i, f in enumerate(FAMILIES)], dense)


def written(hashes: Column) -> Column:
    """The hashes as hexadecimal digits; an empty lexicon's is empty."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(""))), ".")


def agreeing(a: Column, b: Column) -> Column:
    """In how many lexicons of most terms, the whole one and those without a third of it, two texts have the same hash.

    One is enough for I-Match to call them copies.
    """
    own = lambda x: F.concat(F.slice(x, 1, 1), F.slice(x, SPARSE + 1, DENSE))
    return F.size(F.filter(F.arrays_zip(own(a).alias("a"), own(b).alias("b")), lambda x: x["a"] == x["b"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes, among lexicons that either text has terms of, in the sparsest family that has four such.

    Where there are fewer the family with most counts; for texts of no term in the band, equality.
    """
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    out, start = F.when(a.eqNullSafe(b), 1.0).otherwise(0.0), 1
    spans = []
    for _, most in FAMILIES:
        spans.append((start, most))
        start += most

    def share(p: Column, span: tuple[int, int], least: int) -> Column:
        used = F.filter(F.slice(p, *span), lambda x: x["a"].isNotNull() | x["b"].isNotNull())
        return let(used, lambda u: F.when(F.size(u) >= least, F.size(F.filter(u, lambda x: x["a"] == x["b"])) / F.size(u)))

    return F.when(a == b, 1.0).otherwise(let(pairs, lambda p: F.coalesce(*[share(p, s, 4) for s in reversed(spans[1:])], share(p, spans[1], 1), out)))


def fingerprints(docs: DataFrame, low: float = 3.0, high: float = 7.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, ``n_chars``, ``edited_sha256``, both fingerprints, and their likenesses.

    A fingerprint is a hash for each randomised lexicon over the terms in the band of inverse document frequency; a text
    with no such term is fingerprinted by all its terms. ``agree_edited`` and ``agree_next`` count the lexicons of most terms that
    agree; the likenesses ``near_edited`` and ``near_next`` come from the sparse lexicons alone. Null texts count as empty; an only document
    follows itself; repeated rows follow one another and come out as often; null ids come first. Other columns are left.
    """
    docs = named(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    places = save(placed(docs))
    kept = lexicon(docs, places.agg(F.sum("k")).first()[0] or 0, low, high)
    if kept.count() * 16 <= MOST_BYTES:
        kept = F.broadcast(kept)
    rows = followed(docs, places).withColumn("edited", edited(F.col("text"), F.col("ahead")))
    both = rows.select("h1", "h2", "v", F.explode(F.array(F.struct(F.lit(0).alias("side"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("side"), terms(F.col("edited")).alias("terms")))).alias("s"))
    each = both.select("h1", "h2", "v", "s.side", F.explode("s.terms").alias("word")).select("h1", "h2", "v", "side", F.xxhash64("word").alias("term"))
    grouped = each.join(kept, "term").groupBy("h1", "h2", "v", "side").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    prints = grouped.select("h1", "h2", "v", "side", subset_hashes(F.col("terms")).alias("prints"))
    prints = prints.groupBy("h1", "h2", "v").agg(*[F.max(F.when(F.col("side") == side, F.col("prints"))).alias(name) for side, name in enumerate(("own", "other"))])
    whole = lambda text: F.concat(F.array(F.xxhash64(F.sort_array(terms(text)))), F.array_repeat(F.lit(None).cast("long"), SPARSE + DENSE - 1))
    facts = rows.select(
        "h1", "h2", "v", "before", "times", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), whole(F.col("text")).alias("own_all"), whole(F.col("edited")).alias("other_all"),
    )
    found = facts.join(prints, ["h1", "h2", "v"], "left")
    found = save(found.withColumns({"own": F.coalesce("own", "own_all"), "other": F.coalesce("other", "other_all")}).drop("own_all", "other_all"))
    discard(places)
    after = found.where("v = 1").select(F.col("before.h1").alias("h1"), F.col("before.h2").alias("h2"), F.col("own").alias("after"))
    joined = found.join(after, ["h1", "h2"]).withColumn("following", F.when(F.col("v") == 1, F.col("after")).otherwise(F.col("own")))
    shown = joined.select(
        "times", "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
        agreeing(F.col("own"), F.col("other")).alias("agree_edited"), agreeing(F.col("own"), F.col("following")).alias("agree_next"),
    )
    return repeated(shown, "times").drop("times")
