"""Recurring lines and line templates across documents, found by a fixed-depth tree of token counts and leading tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import discard, gathered, let, save

VARIABLE = r"(?<!\S)[^\s0-9]*[0-9]\S*"  # a token with a digit is a variable field wherever it stands
WILDCARD = "<*>"
SPACES = ("  ", "\t", "\r", "\f", "\x0b")


def masked(text: Column) -> Column:
    """A text with single spaces between a line's tokens and a wildcard for each token that holds a digit."""
    uneven = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in SPACES])
    even = F.when(uneven, F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(even, VARIABLE, WILDCARD)).otherwise(even)


def n_tokens(line: Column) -> Column:
    """Tokens of a masked line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def chosen(text: Column, numbers: Column) -> Column:
    """The lines of these numbers; the text is split once."""
    return let(F.split(text, "\n"), lambda lines: F.transform(numbers, lambda i: F.element_at(lines, i + 1)))


def lines_of(docs: DataFrame, least_tokens: int, depth: int) -> DataFrame:
    """The lines that may recur: where each stands, its masked form and that form's place in the tree.

    A leaf holds the lines of one token count and the same ``depth`` leading tokens.
    """
    at = docs.select("doc", "doc_key", F.posexplode(F.split(masked(F.col("text")), "\n")).alias("line_no", "line"))
    return at.select("doc", "doc_key", "line_no", F.btrim("line").alias("line")).where(F.substring_index("line", " ", least_tokens - 1) != F.col("line")).select("doc", "doc_key", "line_no", *marks(F.col("line"), depth))


def marks(line: Column, depth: int) -> list[Column]:
    """Token count, leaf and two hashes of a masked line."""
    return [n_tokens(line).alias("n"), F.xxhash64(n_tokens(line), F.substring_index(line, " ", depth)).alias("leaf"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def distinct_lines(lines: DataFrame) -> DataFrame:
    """A row for each masked line: its first place, and the least and greatest document that has it."""
    place = F.struct("doc", "doc_key", "line_no")
    return lines.groupBy("leaf", "n", "h1", "h2").agg(F.min(place).alias("first"), F.max(F.struct("doc", "doc_key")).alias("last"))


def crowded(docs: DataFrame, distinct: DataFrame, depth: int) -> DataFrame:
    """The lines, with their marks, of leaves of several different ones."""
    several = distinct.groupBy("leaf").count().where("count > 1").select("leaf")
    kept = distinct.join(several, "leaf", "left_semi").select(F.col("first.doc").alias("doc"), F.col("first.doc_key").alias("doc_key"), F.col("first.line_no").alias("line_no"))
    # the texts of the few lines in such leaves come from a second scan, so the first ships hashes alone
    wanted = kept.groupBy("doc", "doc_key").agg(F.collect_set("line_no").alias("wanted"))
    lines = docs.join(wanted, ["doc", "doc_key"]).select(F.explode(chosen(masked(F.col("text")), F.col("wanted"))).alias("line"))
    return save(lines.select(F.btrim("line").alias("line")).select("line", *marks(F.col("line"), depth)))


def templates(rows: DataFrame, depth: int, constant: float) -> DataFrame:
    """``h1``, ``h2``, ``template``: lines whose leaf generalises them with others, and the hash of the form they share.

    In a leaf of several different lines a token that another line has at the same place is constant, any other a
    variable field. A line has a template if at least the share ``constant`` of its tokens are constant and one is not.
    """
    # the leading tokens are constant in the leaf; the rest are counted
    tokens = rows.select("h1", "h2", "n", "leaf", F.posexplode(F.slice(F.split("line", " "), depth + 1, F.greatest(F.col("n") - depth, F.lit(0)))).alias("pos", "token"))
    tokens = tokens.select("h1", "h2", "n", "leaf", F.xxhash64("leaf", "pos", "token").alias("field"))
    often = tokens.groupBy("field").count().where("count > 1").select("field", F.lit(True).alias("fixed"))
    known = tokens.join(often, "field", "left")
    # the sum of mixed constant fields identifies the template; it is the same in any order
    shape = known.groupBy("h1", "h2", "n", "leaf").agg(F.count("fixed").alias("fixed"), F.sum(F.when(F.col("fixed"), F.shiftright("field", 8))).alias("sum"), F.bit_xor(F.when(F.col("fixed"), F.col("field"))).alias("xor"))
    shape = shape.withColumn("variable", F.col("n") - depth - F.col("fixed"))
    shape = shape.where((F.col("variable") > 0) & (F.col("n") - F.col("variable") >= F.col("n") * constant))
    return shape.select("h1", "h2", F.xxhash64("leaf", "sum", "xor", "fixed").alias("template"))


def clusters(rows: DataFrame, constant: float) -> DataFrame:
    """``h1``, ``h2``, ``template``: the lines of a leaf that agree with one form at the share ``constant`` of their places.

    The form has the most frequent token of each place. Lines that it doesn't fit go into another round; a leaf whose form
    fits none is a mixture, and is divided by the token of the place whose most frequent one has the most lines but not
    all. So each round takes lines out of a leaf or divides it, until every leaf left is one line.
    """
    left = rows.dropDuplicates(["h1", "h2"]).select("h1", "h2", "n", "leaf", F.transform(F.split("line", " "), lambda t: F.xxhash64(t)).alias("tokens"))
    found, n = [], rows.count()
    while True:
        counts = left.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count("*").alias("n_lines"))
        places = counts.groupBy("leaf", "pos").agg(F.sum("n_lines").alias("all"), F.max(F.struct("n_lines", "token")).alias("top")).where("all > 1")
        uneven = F.when(F.col("top.n_lines") < F.col("all"), F.struct("top.n_lines", -F.col("pos")))
        forms = places.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "top.token"))).alias("form"), (-F.max(uneven)["col2"]).alias("split"))
        forms = forms.select("leaf", F.transform("form", lambda x: x["token"]).alias("form"), "split")
        same = F.size(F.filter(F.zip_with("tokens", "form", lambda a, b: a == b), lambda x: x))
        judged = left.join(forms, "leaf").withColumns({"fits": same >= F.col("n") * constant, "template": F.xxhash64("leaf", "form")})
        judged = save(gathered(judged.drop("form"), n))
        n = judged.count()
        if not n:
            break
        found.append(judged.where("fits").select("h1", "h2", "template"))
        moved = judged.groupBy("leaf").agg(F.bool_or("fits").alias("moved"))
        part = F.when(F.col("moved"), F.col("leaf")).otherwise(F.xxhash64("leaf", "split", F.get("tokens", F.col("split"))))
        left = judged.where("NOT fits").join(moved, "leaf").select("h1", "h2", "n", part.alias("leaf"), "tokens")
    return reduce(DataFrame.union, found) if found else judged.select("h1", "h2", "template")


def recurring_lines(docs: DataFrame, least_tokens: int, depth: int, constant: float, by_leaf: bool = False) -> DataFrame:
    """``doc``, ``doc_key``, ``drop``: the numbers of the lines of each document whose template an earlier document has.

    Within a document a repeated line is not a recurrence; all its lines up to the first document's are kept.
    """
    lines = lines_of(docs, least_tokens, depth)
    distinct = save(distinct_lines(lines))
    rows = crowded(docs, distinct, depth)
    shared = clusters(rows, constant) if by_leaf else templates(rows, depth, constant)
    forms = distinct.join(shared, ["h1", "h2"], "left")
    owner = F.struct("first.doc", "first.doc_key")
    alone = forms.where(F.col("template").isNull()).select("h1", "h2", owner.alias("owner"), "last")
    named = forms.where(F.col("template").isNotNull())
    groups = named.groupBy("template").agg(F.min(owner).alias("owner"), F.max("last").alias("last"))
    named = named.select("h1", "h2", "template").join(groups, "template").select("h1", "h2", "owner", "last")
    recur = save(alone.union(named).where("owner <> last").select("h1", "h2", "owner"))
    discard(distinct, rows, shared)
    hits = lines.select("doc", "doc_key", "line_no", "h1", "h2").join(recur, ["h1", "h2"])
    hits = hits.where(F.struct("doc", "doc_key") != F.col("owner"))
    return hits.groupBy("doc", "doc_key").agg(F.collect_set("line_no").alias("drop"))


def drop_recurring(docs: DataFrame, least_tokens: int = 3, depth: int = 5, constant: float = 0.8, id_col: str = "doc_id", text_col: str = "text", by_leaf: bool = False) -> DataFrame:
    """All rows with the lines removed that recur from an earlier document, and ``n_lines``, ``n_dropped``.

    A line recurs if another document has the same line but for tokens with digits, or a line of the same template: as many
    tokens, the same ``depth`` leading ones, and others in at most the share 1 - ``constant`` of the places. The document
    with the least id keeps it; lines under ``least_tokens`` tokens stay everywhere. ``by_leaf`` takes templates from clusters of
    a whole leaf's lines; without it each line has its own constant fields, as the SQL of op2 has them. Null texts stay null with no lines.
    Rows of one id and text are one document; rows that share an id but not a text are told apart by a hash of the text, and
    null ids come first. Columns of the input called n_lines or n_dropped are replaced.
    """
    text = F.col(text_col)
    kept = docs.drop("n_lines", "n_dropped")
    keyed = kept.withColumns({"__doc": F.struct(F.col(id_col).alias("id")), "__key": F.xxhash64(text, F.length(text))})
    inner = keyed.where(text.isNotNull()).select(F.col("__doc").alias("doc"), F.col("__key").alias("doc_key"), text.alias("text"))
    drop = recurring_lines(inner, least_tokens, depth, constant, by_leaf).select(F.col("doc").alias("__doc"), F.col("doc_key").alias("__key"), F.col("drop").alias("__drop"))
    n_lines = F.size(F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__drop"))
    joined = keyed.join(drop, ["__doc", "__key"], "left")
    changed = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(chosen(text, left), "\n"))
    counts = {"n_lines": F.coalesce(n_lines, F.lit(0)), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0))}
    return joined.select(*[changed.alias(c) if c == text_col else F.col(c) for c in kept.columns], *[v.cast("int").alias(k) for k, v in counts.items()])
