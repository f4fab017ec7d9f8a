"""Language identification by cross-parsing: the language whose training text explains a document in the fewest phrases."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import kept_by_worker, parts_of

UNDETERMINED = "und"
PREDICTED = "struct<lang_pred: string, score: double, phrases: array<bigint>>"
UNKNOWN, SPACE, FIRST = 0, 1, 2  # codes of a letter that no language was seen with, of what is no letter, of the first letter
BLOCK = 1024  # characters that are parsed side by side with those of other blocks
SEGMENT = 1 << 20  # of longer texts so many characters are in memory as codes at once
CELLS, COLUMN = 1 << 24, 64  # bytes that are parsed together, and those of a block's column beside its characters


def folded(text: str) -> str:
    """Lower case; what is not a letter becomes a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of a text; state 0 is its start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def displaced(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, int]:
    """Where each row of codes begins in one common array, so that no two have a place in common, and that array's size.

    Rows of many codes go first, each to the first place that has room; rows of a single code fill the gaps.
    """
    total = sum(map(len, rows))
    taken = np.zeros(2 * total + 4 * width + 64, bool)
    start, low = np.zeros(len(rows), np.int64), width  # a code is at most width, so no row begins before 0
    for i in sorted((i for i, r in enumerate(rows) if len(r) > 1), key=lambda i: -len(rows[i])):
        ahead = rows[i] - rows[i][0]
        while True:
            if low + ahead[-1] + 64 > len(taken):
                taken = np.append(taken, np.zeros(len(taken) + ahead[-1] + 64, bool))
            fits = ~taken[low : low + 64]
            for k in ahead[1:]:
                fits = fits & ~taken[low + k : low + k + 64]
            place = low + int(fits.argmax())
            if fits[place - low]:
                break
            low += 64  # too full for the rows to come; those of a single code fill it
        taken[place + ahead] = True
        start[i] = place - rows[i][0]
    single = [i for i, r in enumerate(rows) if len(r) == 1]
    taken = np.append(taken, np.zeros(len(single), bool))
    gaps = width + np.flatnonzero(~taken[width:])[: len(single)]
    start[single] = gaps - np.array([rows[i][0] for i in single], np.int64)
    taken[gaps] = True
    return start, int(np.flatnonzero(taken).max(initial=0)) + width + 1


@dataclass
class Languages:
    """The automata of all languages in one array, by row displacement: a state's transition by a code is at their sum.

    A place belongs to a state only if ``owner`` says so; otherwise the phrase ends before the character, and the next
    begins with the language's ``first`` transition.
    """

    names: list[str]
    letters: str
    sizes: list[int]  # training characters
    starts: np.ndarray  # each language's state before any phrase
    first: np.ndarray  # language x code: the state of a phrase of that one character
    begin: np.ndarray  # by state
    owner: np.ndarray  # by place
    target: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, str]) -> Languages:
        """The automata of a folded text for each language."""
        letters = "".join(sorted(set("".join(texts.values())) - {" "}))
        code = {c: i for i, c in enumerate(letters, FIRST)} | {" ": SPACE}
        width = len(letters) + FIRST
        first, starts, rows, targets = np.zeros((len(texts), width), np.int64), [], [], []
        for number, text in enumerate(texts.values()):
            go, base = suffix_automaton([code[c] for c in text]), len(rows)
            starts.append(base)
            first[number] = base  # no phrase holds an unknown character, so the state after it is the one before any
            for c, t in go[0].items():
                first[number, c] = base + t
            for state, row in enumerate(go):
                held = sorted(row) if state else []
                rows.append(np.array(held, np.int64))
                targets.append([base + row[c] for c in held])
        begin, size = displaced(rows, width)
        owner, target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        if rows:
            own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            places = begin[own] + np.concatenate(rows)
            owner[places], target[places] = own, np.array([t for some in targets for t in some], np.int64)
        return cls(list(texts), letters, [len(t) for t in texts.values()], np.array(starts, np.int64), first, begin, owner, target)

    def codes(self, lower: str) -> np.ndarray:
        """A code for each character of a lower-case text."""
        table = kept_by_worker("language", self.letters, lambda: code_table(self.letters))
        return table[np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def step(self, state: np.ndarray, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of them begin a phrase. ``row``: where the language's first transitions lie."""
        at = self.begin.take(state)
        at += code
        new = self.owner.take(at) != state
        after = self.target.take(at)
        np.copyto(after, self.first.take(row + code), where=new)
        return after, new

    def parse(self, texts: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each text (column) by each language (row), and the states at its end, from the given states.

        All blocks of all texts are parsed side by side, those that aren't a text's first as if a phrase began there. Then
        each goes on from the end of the one before it until both parses begin a phrase at the same character, from
        where they agree. A block that they never agree in passes its own end on to the next one.
        """
        langs = len(self.names)
        counts, end = np.zeros((langs, len(texts)), np.int64), state.copy()
        parts = sorted(((i, k) for i, t in enumerate(texts) for k in range(0, len(t), BLOCK)), key=lambda p: -min(BLOCK, len(texts[p[0]]) - p[1]))
        if not parts or not langs:
            return counts, end
        lane = {p: j for j, p in enumerate(parts)}
        size = np.array([min(BLOCK, len(texts[i]) - k) for i, k in parts])
        grid = np.zeros((size[0], len(parts)), np.int32)
        for j, (i, k) in enumerate(parts):
            grid[: size[j], j] = texts[i][k : k + BLOCK]
        row = (np.arange(langs) * self.first.shape[1])[:, None]
        now = np.where([k == 0 for _, k in parts], state[:, [i for i, _ in parts]], self.starts[:, None])
        begins = np.zeros((len(grid), langs, len(parts)), bool)
        lanes = np.searchsorted(-size, -np.arange(1, len(grid) + 1), side="right")  # those with a character at each step
        for t, n in enumerate(lanes):
            now[:, :n], begins[t, :, :n] = self.step(now[:, :n], row, grid[t, :n])
        found, alone = begins.sum(0), now.copy()
        before = np.array([lane.get((i, k - BLOCK), -1) for i, k in parts])
        after = np.full(len(parts), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        lang, at = (x.ravel() for x in np.meshgrid(np.arange(langs), np.flatnonzero(before >= 0), indexing="ij"))
        while len(at):
            own, of, st = now[lang, before[at]], lang, at
            n = np.zeros(len(at), np.int64)
            which, last = np.arange(len(at)), alone[lang, at]
            for t in range(len(grid)):
                ended = size[st] <= t
                if ended.any():
                    last[which[ended]] = own[ended]
                    which, own, of, st = which[~ended], own[~ended], of[~ended], st[~ended]
                if not len(which):
                    break
                own, new = self.step(own, row[of, 0], grid[t, st])
                ours = begins[t, of, st]
                n[which] += new.astype(np.int64) - ours
                apart = ~(new & ours)
                which, own, of, st = which[apart], own[apart], of[apart], st[apart]
            last[which] = own
            found[lang, at] = begins[:, lang, at].sum(0) + n
            again = (now[lang, at] != last) & (after[at] >= 0)
            now[lang, at] = last
            lang, at = lang[again], after[at[again]]
        for j, (i, k) in enumerate(parts):
            counts[:, i] += found[:, j]
            if k + BLOCK >= len(texts[i]):
                end[:, i] = now[:, j]
        return counts, end

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each whole text (row) in each language (column), how many are letters new to it, and the texts' letters."""
        lower = [t.lower() for t in texts]
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        new, letters = counts.copy(), np.zeros(len(texts), np.int64)
        strange = (self.first == self.starts[:, None]).T.astype(np.int64)
        strange[SPACE] = 0

        def tally(i: int, codes: np.ndarray) -> None:
            seen = np.bincount(codes, minlength=len(strange))
            new[i] += seen @ strange
            letters[i] += len(codes) - seen[SPACE]

        segment = max(BLOCK, min(SEGMENT, CELLS // max(1, len(self.names)) // BLOCK * BLOCK))
        short = [i for i, t in enumerate(lower) if len(t) <= segment]
        for some in side_by_side([len(lower[i]) for i in short], len(self.names)):
            at = [short[k] for k in some]
            codes = [self.codes(lower[i]) for i in at]
            for i, c in zip(at, codes):
                tally(i, c)
            counts[at] = self.parse(codes, np.repeat(self.starts[:, None], len(at), axis=1))[0].T
        for i in set(range(len(texts))) - set(short):
            state = self.starts[:, None]
            for k in range(0, len(lower[i]), segment):
                piece = self.codes(lower[i][k : k + segment])
                more, state = self.parse([piece], state)
                counts[i] += more[:, 0]
                tally(i, piece)
        return counts, new, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[int]]]:
        """Language, score and phrases of each text.

        A phrase costs the logarithm of the language's training size, or that of all code points if it is a letter new to
        the language; the cheapest language wins. The score is one minus the ratio of the least cost to the second (1 if there
        is one language); ties go to the first name, with score 0. A text that is null or has no letter is ``und`` with score 0.
        """
        few = max(1, CELLS // 64 // max(1, len(self.names)))  # texts whose counts are in memory at once
        if len(texts) > few:
            return [p for k in range(0, len(texts), few) for p in self.predict(texts[k : k + few])]
        phrases, new, letters = self.phrases([t or "" for t in texts])
        costs = (phrases - new) * np.log2(np.maximum(2, self.sizes)) + new * math.log2(0x110000)
        out = []
        for known, row, cost in zip(letters, phrases, costs):
            if not self.names or not known:
                out.append((UNDETERMINED, 0.0, row.tolist()))
                continue
            best = int(cost.argmin())
            second = np.partition(cost, 1)[1] if len(cost) > 1 else np.inf
            out.append((self.names[best], float(1 - cost[best] / second), row.tolist()))
        return out


def side_by_side(lengths: list[int], languages: int) -> Iterator[list[int]]:
    """The numbers of texts in groups that are parsed together, short ones with short ones.

    Every block of a group takes a column as high as its longest, for each language; a group has ``CELLS`` such cells, or one text.
    """
    group: list[int] = []
    blocks = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        more = -(-lengths[i] // BLOCK) or 1
        height = min(BLOCK, lengths[i]) + COLUMN
        if group and (blocks + more) * height * languages > CELLS:
            yield group
            group, blocks = [], 0
        group.append(i)
        blocks += more
    if group:
        yield group


def code_table(letters: str) -> np.ndarray:
    """Codes of all code points."""
    table = np.array([UNKNOWN if chr(p).isalpha() else SPACE for p in range(0x110000)], np.int32)
    for i, c in enumerate(letters, FIRST):
        table[ord(c)] = i
    return table


def sample(labelled: DataFrame, text_col: str, lang_col: str, chars: int, piece: int) -> dict[str, list[str]]:
    """At least ``chars`` characters of each language where there are as many: the first ``piece`` of distinct texts, drawn by a hash."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.left(F.col(text_col), F.lit(piece)).alias("text"), F.xxhash64(F.col(text_col)).alias("draw"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 4 * chars / n))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).dropDuplicates(["lang", "draw"])
    found: dict[str, list[str]] = {}
    for r in sorted(drawn.select("lang", "draw", "text").collect()):
        found.setdefault(r.lang, []).append(r.text)
    for lang in sizes.keys() - found.keys():  # a few texts that no draw fell on
        found[lang] = [r.text for r in rows.where(F.col("lang") == lang).orderBy("draw").select("text").limit(4).collect()]
    return found


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", chars: int = 32_768, piece: int = 2048) -> Languages:
    """Builds the automata from a bounded sample: ``chars`` characters of text for each language, ``piece`` at most from a text.

    Copies of a text count once. Rows with a null language, or whose text has no letter, are left out. Letters that no sample has
    are phrases by themselves. No rows: no languages, and every text is ``und``.
    """
    found = sample(labelled, text_col, lang_col, chars, piece)
    return Languages.of({lang: folded("\n".join(t))[:chars] for lang, t in sorted(found.items())})


def identify(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``phrases`` (one count for each learned language) to every row.

    Whole texts are parsed; only they and the new columns pass through Python. A column of the input with one of these names is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(languages)  # a megabyte or two for each language
    kept = docs.drop("lang_pred", "score", "phrases")

    @F.arrow_udf(PREDICTED)
    def predicted(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        lang, score, phrases = zip(*(p for _, held in parts_of([whole], 0) for p in model.value.predict(held)))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(phrases, pa.list_(pa.int64()))], names=["lang_pred", "score", "phrases"])

    # not deterministic for the optimizer, which would otherwise call it once more for a filter on what it returns
    once = predicted.asNondeterministic()
    return kept.withColumn("__predicted", once(F.col(text_col))).select(*kept.columns, "__predicted.*")
