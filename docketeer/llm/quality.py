"""Document quality by co-training: a classifier of the text and one of the metadata teach each other, then both score."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docketeer.llm.common import discard, parts_of, save

GRAMS = WORDS = 1 << 16  # buckets of byte trigrams and of words
SLOTS = 1 << 20  # of metadata values: many times more than there are values, so that hardly two share one
COUNTS = "feature long, bad double, good double"
_draws = np.random.default_rng(8)
POWERS = _draws.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE, LOWER, UPPER, DIGIT, STOP, MARK, OTHER = range(7)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[0, 9, 10, 11, 12, 13, 32]] = SPACE
    kinds[97:123], kinds[65:91], kinds[48:58] = LOWER, UPPER, DIGIT
    kinds[list(b".!?")] = STOP
    kinds[[c for c in range(33, 127) if kinds[c] == OTHER]] = MARK
    return kinds


KINDS = _classes()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float | np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights, the last of them the intercept, of a penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.broadcast_to(penalty, x.shape[1] - 1), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Texts:
    """The hashed byte trigrams and words of some whole texts."""

    def __init__(self, texts: list[str | None]) -> None:
        held = [(t or "").encode() for t in texts]
        self.n = len(held)
        self.size = np.array([len(t) for t in held], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 2)[:-1]]).astype(np.int64) if held else np.empty(0, np.int64)
        self.bytes = np.frombuffer(b"".join(t + b"\0\0" for t in held) + b"\0\0", np.uint8)
        wide = self.bytes.astype(np.uint64)
        grams = wide[:-2] * POWERS[0] + wide[1:-1] * POWERS[1] + wide[2:] * POWERS[2]
        self.grams = (grams * MIX >> np.uint64(48)).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n), self.size + 2)  # of each byte; a text's last two are no text of its own
        self.kinds = KINDS[self.bytes]
        inside = self.kinds != SPACE
        first = inside & ~np.concatenate([[False], inside[:-1]])
        begins = np.flatnonzero(first)
        at = np.arange(len(wide)) - (begins[np.cumsum(first) - 1] if len(begins) else 0)
        value = np.where(inside, (wide + np.uint64(1)) * POWERS[at & 63], np.uint64(0))
        self.words = np.add.reduceat(value, begins) if len(begins) else np.empty(0, np.uint64)
        self.word_doc = self.doc[begins]
        self.buckets = ((self.words ^ (self.words >> np.uint64(29))) * MIX >> np.uint64(48)).astype(np.int64)

    def own(self) -> np.ndarray:
        """Which trigrams begin inside of a text."""
        return np.arange(len(self.doc)) - self.start[self.doc] < self.size[self.doc]

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Trigrams and words of all texts together, each text with its weight."""
        some = self.own() & (weight[self.doc] != 0)
        grams = np.bincount(self.grams[: len(self.doc)][some], weight[self.doc[some]], GRAMS)
        return np.concatenate([grams, np.bincount(self.buckets, weight[self.word_doc], WORDS)])

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Each text's mean weight of its trigrams, and of its words."""
        grams = np.bincount(self.doc, np.where(self.own(), weights[self.grams[: len(self.doc)]], 0.0), self.n)
        words = np.bincount(self.word_doc, weights[GRAMS + self.buckets], self.n)
        return np.column_stack([grams / np.maximum(1, self.size), words / np.maximum(1, self.n_words())])

    def n_words(self) -> np.ndarray:
        return np.bincount(self.word_doc, minlength=self.n)

    def measures(self) -> np.ndarray:
        """Of each text: length, word length, shares of kinds of characters, sentence ends a word, repeated words."""
        kinds = np.bincount(self.doc * 7 + self.kinds[: len(self.doc)], minlength=7 * self.n).reshape(-1, 7)[:, 1:]
        size, words = np.maximum(1, self.size), np.maximum(1, self.n_words())
        order = np.lexsort((self.words, self.word_doc))
        doc, word = self.word_doc[order], self.words[order]
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
        distinct = np.bincount(doc[new], minlength=self.n)
        again = np.zeros(len(self.words), bool)
        again[1:] = (self.words[1:] == self.words[:-1]) & (self.word_doc[1:] == self.word_doc[:-1])
        return np.column_stack([
            np.log1p(self.size), np.minimum(size / words, 40), kinds[:, [UPPER - 1, DIGIT - 1, MARK - 1, OTHER - 1]] / size[:, None],
            kinds[:, STOP - 1] / words, distinct / words, np.bincount(self.word_doc, again, self.n) / words,
        ])


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Naive Bayes weights of features: the logarithm of how much likelier each is in good rows; 0 for one never seen."""
    seen = good + bad > 0
    share = lambda n: np.log((n + 0.5) / (n.sum() + 0.5 * max(1, seen.sum())))
    return np.where(seen, share(good) - share(bad), 0.0)


@dataclass
class Line:
    """A calibrated line through standardised inputs: log-odds of good quality."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float | np.ndarray = 0.1) -> Line:
        mean, spread = x.mean(0), x.std(0)
        spread[spread < 1e-9] = 1
        return cls(mean, spread, logistic((x - mean) / spread, y, penalty))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -10, 10) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """Both views; None without labelled rows of both classes."""

    columns: list[str]
    share: float  # of good rows
    features: np.ndarray | None = None  # weights of trigrams, words
    slots: np.ndarray | None = None  # and of metadata values
    text: Line | None = None
    page: Line | None = None

    def inputs(self, texts: Texts, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the lines of the text view and of the metadata view take."""
        return np.column_stack([texts.means(self.features), texts.measures()]), self.slots[slots].sum(1, keepdims=True)


def prepared(docs: DataFrame, columns: list[str], text_col: str = "text") -> list:
    """The text, and the slot of each metadata value (a null counts as a value of its own)."""
    slots = [F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(SLOTS)) for c in columns]
    return [F.col(text_col).cast("string").alias("__text"), F.array(*slots).cast("array<long>").alias("__slots")]


def in_batches(batches: Iterable[pa.RecordBatch], text: str = "__text", slots: str = "__slots") -> Iterator[tuple[pa.RecordBatch, Texts, np.ndarray]]:
    for batch in batches:
        for part, texts in parts_of([batch], batch.schema.get_field_index(text)):
            yield part, Texts(texts), part.column(slots).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def counted(rows: DataFrame, label: Callable[[pa.RecordBatch, Texts, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Feature counts by class over all rows: row 0 bad, row 1 good; trigrams, words and metadata slots side by side.

    ``label`` gives each row's class for the text view and for the metadata view: 1, 0, or NaN to leave it out. A task passes on a
    row for each feature it met, so what reaches the driver has the size of the feature space, whatever the input's.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, GRAMS + WORDS + SLOTS))
        for part, texts, slots in in_batches(batches):
            for_text, for_page = label(part, texts, slots)
            for c in (0, 1):
                if (for_text == c).any():
                    total[c, : GRAMS + WORDS] += texts.counts((for_text == c).astype(float))
                np.add.at(total[c], GRAMS + WORDS + slots[for_page == c].ravel(), 1.0)
        met = np.flatnonzero(total.any(0))
        for k in range(0, len(met), 10_000):
            some = met[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "bad", "good"])

    got = rows.mapInArrow(run, COUNTS).groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts = np.zeros((2, GRAMS + WORDS + SLOTS))
    for c, name in enumerate(("bad", "good")):
        counts[c, got.column("feature").to_numpy()] = got.column(name).to_numpy()
    return counts


def views(columns: list[str], counts: np.ndarray, share: float) -> Model:
    """Naive Bayes weights from the counts; the lines are not fitted yet."""
    n = GRAMS + WORDS
    weights = [log_ratios(counts[1, a:b], counts[0, a:b]) for a, b in ((0, GRAMS), (GRAMS, n), (n, n + SLOTS))]
    return Model(columns, share, np.concatenate(weights[:2]), weights[2])


def calibrated(model: Model, labelled: DataFrame) -> Model:
    """Fits both lines on the labelled rows that the weights were not learned from."""
    spark = labelled.sparkSession
    held = spark.sparkContext.broadcast(model)
    width = 2 + 9 + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, slots in in_batches(batches):
            x = np.column_stack(held.value.inputs(texts, slots))
            yield pa.RecordBatch.from_arrays([part.column("__good").cast(pa.float64()), part.column("__draw"), *[pa.array(c) for c in x.T.copy()]], names=["good", "draw", *[f"x{i}" for i in range(width)]])

    schema = "good double, draw long, " + ", ".join(f"x{i} double" for i in range(width))
    got = labelled.where("__check").mapInArrow(run, schema).orderBy("draw", "x0", "x1").toArrow()
    x = np.column_stack([got.column(f"x{i}").to_numpy() for i in range(width)])
    y = got.column("good").to_numpy()
    # style says less of unseen kinds of text than the learned weights do, so it costs more
    model.text, model.page = Line.fit(x[:, :-1], y, np.repeat([0.1, 10.0], [2, width - 3])), Line.fit(x[:, -1:], y)
    held.destroy()
    return model


def learn(docs: DataFrame, labels: DataFrame, columns: list[str], most_labelled: int = 100_000, rounds: int = 2, confidence: float = 0.95, text_col: str = "text") -> Model:
    """Co-trains the two views on at most about ``most_labelled`` labelled rows, chosen by a hash of the id, and on all others.

    ``docs``: doc_id, text and the metadata ``columns``. ``labels``: doc_id, good (0 or 1; rows with a null are left out, of
    several labels of a document the lowest counts). The text view: naive Bayes weights of hashed byte trigrams and words, whose
    means go into a line together with measures of style. The metadata view: a naive Bayes weight for each value. The lines are
    fitted on a fifth of the labelled rows, from which no weights are learned. In each round every document that is not among the labelled
    ones gets a label for one view if the other is surer than ``confidence``, and the weights are learned anew from all.
    Without labelled documents of both classes there are no views.
    """
    labels = labels.dropna(subset=["doc_id", "good"]).groupBy("doc_id").agg(F.min("good").cast("double").alias("__good"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    some = labels.where(draw < (1 << 30) * min(1.0, most_labelled / max(1, labels.count())))
    rows = docs.select("doc_id", *prepared(docs, columns, text_col)).join(F.broadcast(some), "doc_id", "left").withColumn("__draw", draw)  # some: bounded by most_labelled
    rows = rows.withColumn("__check", F.pmod(F.col("__draw"), F.lit(5)) == 0).drop("doc_id")
    labelled = save(rows.where("__good IS NOT NULL"))
    tally = {(r["__check"], r["__good"]): r["count"] for r in labelled.groupBy("__check", "__good").count().collect()}
    n_good, n = sum(v for (_, g), v in tally.items() if g > 0), sum(tally.values())
    share = (n_good + 1) / (n + 2)
    if n_good in (0, n):
        return Model(columns, share)
    if len(tally) < 4:  # too few for a part that is held back
        labelled = save(labelled.withColumn("__check", F.lit(True)))

    whole = len(tally) < 4
    known = lambda part, *_: (part.column("__good").to_numpy(zero_copy_only=False),) * 2
    base = counted(labelled if whole else labelled.where("NOT __check"), known)
    model = calibrated(views(columns, base, share), labelled)
    limit = float(np.log(confidence / (1 - confidence)))
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(model)

        def exchanged(part: pa.RecordBatch, texts: Texts, slots: np.ndarray, held=held) -> tuple[np.ndarray, np.ndarray]:
            text, page = (line.logit(x) for line, x in zip((held.value.text, held.value.page), held.value.inputs(texts, slots)))
            sure = lambda x: np.where(np.abs(x) >= limit, (x > 0).astype(float), np.nan)
            return sure(page), sure(text)

        model = calibrated(views(columns, base + counted(rows.where("__good IS NULL"), exchanged), share), labelled)
        held.destroy()
    discard(labelled)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds to every row ``text_score``, ``page_score`` and ``score``: the probability of good quality by each view and by both.

    The views' calibrated log-odds add up, less those of the classes. Nulls, empty texts, unseen values and repeated rows have scores
    like any other. A model without views gives null for each, and the share of good labels (a half without labels) for
    both. Columns of the input with these names are replaced.
    """
    kept = docs.drop("text_score", "page_score", "score")
    fields = [StructField(c, DoubleType()) for c in ("text_score", "page_score", "score")]
    if model.text is None:
        return kept.select(*kept.columns, F.lit(None).cast("double").alias("text_score"), F.lit(None).cast("double").alias("page_score"), F.lit(model.share).alias("score"))
    held, n_kept = docs.sparkSession.sparkContext.broadcast(model), len(kept.columns)  # the model has the size of the feature space

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = np.log(held.value.share / (1 - held.value.share))
        for part, texts, slots in in_batches(batches):
            text, page = (line.logit(x) for line, x in zip((held.value.text, held.value.page), held.value.inputs(texts, slots)))
            new = [pa.array(sigmoid(x)) for x in (text, page, text + page - prior)]
            yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *new], names=[*part.schema.names[:n_kept], "text_score", "page_score", "score"])

    return kept.select("*", *prepared(kept, model.columns, text_col)).mapInArrow(run, StructType([*kept.schema.fields, *fields]))
