"""A positional index of stemmed words, and a rank that grows as a question's words come closer."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions.stemming import lexeme_positions, query_terms, words
from docketeer.sources.shared import scratch

# Fixed values of the rank: the weight of a word that isn't in a title or heading, and how far apart two words still count.
WEIGHT, FARTHEST = 0.1, 100


def postings(paragraphs: DataFrame, text: str = "body") -> DataFrame:
    """``term``, ``positions`` (from 1, stop words counted) and the paragraph's other columns: a row for each distinct lexeme of each paragraph.

    Null texts have none.
    """
    carried = [c for c in paragraphs.columns if c not in (text, "term", "positions")]
    found = paragraphs.select(*carried, F.explode(lexeme_positions()(words(F.col(text)))).alias("p"))
    return found.select("p.term", "p.positions", *carried)


def write_postings(paragraphs: DataFrame, path: str, text: str = "body") -> None:
    """Writes the postings in the order of their terms, so that a question reads only the row groups of its own.

    They are dealt by ranges of term and id: a frequent term is in several files, a rare one beside its neighbours.
    """
    spark = paragraphs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    with scratch(spark) as found:
        # the ranges are sampled before the rows are dealt; words would be stemmed for each of the two
        postings(paragraphs.repartition(parts, "id"), text).write.parquet(found)
        rows = spark.read.parquet(found)
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def closeness(a: Column, b: Column) -> Column:
    """What is left of 1 after each pair of places of two words has taken its share, which falls with their distance.

    Pairs farther apart than ``FARTHEST`` would take less than 10^-15 each and are left out.
    """
    apart = lambda p, q: F.abs(p - q)
    share = lambda d: WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    near = lambda p: F.filter(b, lambda q: (apart(p, q) > 0) & (apart(p, q) <= FARTHEST))
    return F.aggregate(a, F.lit(1.0), lambda left, p: left * F.aggregate(near(p), F.lit(1.0), lambda own, q: own * (1 - share(apart(p, q)))))


def single(positions: Column) -> Column:
    """The rank of a question of one word: its n-th place adds the n-th part, squared, of what the first does."""
    sums = F.aggregate(F.sequence(F.lit(1), F.size(positions)), F.lit(0.0), lambda s, n: s + WEIGHT / (n * n))
    return sums / 1.64493406685  # the sum of 1 / n^2 for all n


def rank(places: Column, terms: list[str]) -> Column:
    """The rank of a paragraph that has all terms, from a map of its terms to their places."""
    if len(terms) == 1:
        return single(places[terms[0]])
    left = reduce(Column.__mul__, [closeness(places[a], places[b]) for a, b in combinations(terms, 2)])
    return F.greatest(1 - left, F.lit(1e-20))


def matching(index: DataFrame, question: str) -> DataFrame:
    """The paragraphs that have all lexemes of a question, with their ``lexical`` rank (to nine places).

    Only the question's own postings are read. A question of stop words alone matches nothing.
    """
    terms = query_terms(question)
    carried = [c for c in index.columns if c not in ("term", "positions")]
    found = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    # a paragraph has one row for each term, so no more than the question has
    met = found.groupBy(*carried).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places")).where(F.size("places") == len(terms))
    return met.select(*carried, F.round(rank(F.col("places"), terms) if terms else F.lit(0.0), 9).alias("lexical"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
