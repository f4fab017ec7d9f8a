"""What is measured rather than proven: sequences against the least number, links of similar texts that are found."""

import random
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from docketeer.llm import packing, simhash
from docketeer.llm.common import documents
from docketeer.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_sequences_against_the_least_number(spark):
    packed = packing.pack_documents(documents(spark, SF), tokenizer_path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n, tokens, most = packed.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert most <= 4096 and n <= 1.01 * -(-tokens // 4096), (n, tokens)


def test_planted_pairs_of_little_more_than_the_similarity(spark):
    """A thousand pairs of texts with a similarity of 0.8 to 0.85, and as many just below 0.8, none of which may link."""
    r = random.Random(33)
    rows, near, far = [], [], []
    while len(near) < 1000 or len(far) < 1000:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 200))]
        other = words[:]
        for _ in range(r.randrange(1, 5)):
            other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
        a, b = set(brute.shingles(" ".join(words), 5)), set(brute.shingles(" ".join(other), 5))
        likeness = len(a & b) / len(a | b)
        kind = near if 0.8 <= likeness < 0.85 else far if 0.74 <= likeness < 0.8 else None
        if kind is not None and len(kind) < 1000:
            kind.append(len(rows))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in near if found[i] != found[i + 1]] == []
    assert [i for i in far if found[i] == found[i + 1]] == []
