"""Secrets in texts: fixed patterns, and weaker credentials that count only together with their other parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import let, save

#: Base kinds in the order of the contract: name, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What finds the texts in which a kind can match at all.
HINTS = {"key": r"[A-Za-z0-9+/_-]{20}", "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}

#: Parts of a credential that alone say little: name, pattern, what counts, least of it. DISTINCT: not a group's length, but how many
#: different characters the match has; a bare key is a run of mixed characters without a keyword before it.
DISTINCT = -1
WEAK = (
    ("user", r"""\b(?i:user|username|user_id|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+)""", 1, 3),
    ("pass", r"""\b(?i:pwd|pass|passphrase|credential|auth|private_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]+)""", 1, 4),
    ("endpoint", r"""\b(?i:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp|ssh|ldaps?)://[^\s"'<>]+""", 0, 8),
    ("key", r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", DISTINCT, 12),
)
ROLES = {"assign": "secret", "hex": "secret", "pass": "secret", "key": "secret", "access": "id", "user": "id", "endpoint": "place"}
SPAN = "array<struct<start:long,kind_no:int,kind:string,end:long>>"


def running(lengths: Column, width: int = 64) -> Column:
    """Sums of what precedes each element, in blocks, so that a text with very many matches doesn't cost their square."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    block = lambda i: F.floor(i / width).cast("int")
    sums = F.transform(F.sequence(F.lit(0), block(F.size(lengths))), lambda b: total(F.slice(lengths, b * width + 1, F.lit(width))))
    before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
    return let(before, lambda s: F.transform(lengths, lambda _, i: F.element_at(s, block(i) + 1) + total(F.slice(lengths, block(i) * width + 1, i % width))))


def spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int, hint: str | None = None) -> Column:
    """The matches of a pattern, leftmost first, without those whose group is too short; positions in code points.

    The text between the matches comes from a split by the same pattern, so the lengths of both give the positions.
    """
    sizes = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    if group == DISTINCT:
        own = lambda m: F.size(F.array_distinct(F.split(m, "")))
    else:
        own = lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = let(found, lambda f: F.struct(sizes(F.split(text, pattern, -1)).alias("gaps"), sizes(f).alias("wide"), F.transform(f, lambda m: own(m).cast("long")).alias("own")))
    through = lambda m: F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["wide"])), m["wide"], lambda gap, n: gap + n)
    before = lambda m: let(through(m), running)
    rows = lambda m: F.arrays_zip(before(m).alias("before"), F.slice(m["gaps"], F.lit(1), F.size(m["wide"])).alias("gap"), m["wide"].alias("n"), m["own"].alias("own"))
    span = lambda r: F.struct((r["before"] + r["gap"]).alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), (r["before"] + r["gap"] + r["n"]).alias("end"))
    kept = let(matches, lambda m: F.transform(F.filter(rows(m), lambda r: r["own"] >= least), span))
    return F.when(text.rlike(hint or pattern), kept).otherwise(F.array().cast(SPAN))


def written(found: Column) -> Column:
    """kind:start:end, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that have a complementary part within ``reach`` code points in the same text.

    ``parts``: key, start, end, kind, kind_no. An interval join: parts are dealt to every scope of ``reach`` code points
    that they or their surroundings touch, and meet there; no pairs are made. An identifier and a place complement a secret and
    vice versa; an identifier and a place without a secret give nothing away. A bare key that overlaps a part of
    another kind is that part's value, and no part of its own.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    parts = parts.withColumn("secret", role == "secret")
    own = parts.withColumn("scope", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    near = F.sequence(F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / reach), F.floor((F.col("end") + reach) / reach))
    weak = parts.where(F.col("kind").isin([w[0] for w in WEAK])).withColumn("scope", F.explode(near))
    # a scope is short, so it has few parts
    scopes = own.groupBy("key", "scope").agg(F.collect_set(F.struct("start", "end", "secret", (F.col("kind") == "key").alias("bare"))).alias("others"))
    met = weak.join(scopes, ["key", "scope"])
    completes = lambda o: (o["secret"] != F.col("secret")) & (o["start"] <= F.col("end") + reach) & (o["end"] >= F.col("start") - reach)
    holds = lambda o: ~o["bare"] & (o["start"] < F.col("end")) & (o["end"] > F.col("start"))
    judged = met.groupBy("key", "start", "kind_no", "kind", "end").agg(F.bool_or(F.exists("others", completes)).alias("completed"), F.bool_or(F.exists("others", holds)).alias("held"))
    return judged.where("completed AND NOT (kind = 'key' AND held)").drop("completed", "held")


def scan(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with ``base`` and ``all_spans``, arrays of (start, kind_no, kind, end).

    ``base`` are the matches of the fixed patterns in the whole text; ``all_spans`` adds weak identifiers, secrets (bare keys among
    them) and endpoints that lie within ``reach`` code points of a complementary part. A null text counts as empty. Rows that agree in id
    and text, null ids included, get the same spans each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = F.concat(*[spans(F.col("text"), i, kind, pattern, group, least, HINTS[kind]) for i, (kind, pattern, group, least) in enumerate(BASE)])
    weak = F.concat(*[spans(F.col("text"), len(BASE) + i, *w, HINTS.get(w[0])) for i, w in enumerate(WEAK)])
    key = F.xxhash64(F.col("doc_id"), "text", F.length("text"))
    rows = save(rows.select("doc_id", key.alias("key"), base.alias("base"), weak.alias("weak")))
    some = rows.where(F.size("weak") > 0).select("key", F.explode(F.concat("base", "weak")).alias("s")).select("key", "s.*").distinct()
    found = linked(some, reach).groupBy("key").agg(F.collect_set(F.struct("start", "kind_no", "kind", "end")).alias("more"))
    all_spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return rows.join(found, "key", "left").select("doc_id", "base", all_spans.alias("all_spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts and written spans of what ``scan`` found."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"),
    )
