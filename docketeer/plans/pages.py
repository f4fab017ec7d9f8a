"""Pages and their lines: assembly, sections, reports of clean-up, question types, batches with a way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions import documents as N
from docketeer.functions import drafting as D
from docketeer.functions import translation as T
from docketeer.operators import assembly as A
from docketeer.operators import scans as P
from docketeer.operators.workspace import checked, translated_batch
from docketeer.plans.ordered import cause_rows
from docketeer.plans.registry import query
from docketeer.plans.texts import docs
from docketeer.sources.tables import table


def spoken(text: Column) -> Column:
    """What stands for a translation."""
    return F.replace(text, F.lit("e"), F.lit("3"))


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the lines of an order's block, on a page 600 wide: some share a height, some stand in the right column."""
    y, side = (F.col("l_linenumber") - F.col("l_linenumber") % 2) * 10.0 + F.col("l_partkey") % 5, F.col("l_suppkey") % 3
    x0 = F.when(side == 0, 40.0).when(side == 1, 320.0).otherwise(150.0)
    text = F.when(F.col("l_quantity") < 3, "").otherwise(F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string"), F.when(F.col("l_partkey") % 4 == 0, " ").otherwise("")))
    order = F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("long").alias("page"), F.col("l_orderkey").alias("block"), order.alias("n"), x0.alias("x0"), y.alias("y0"), (x0 + F.col("l_quantity") * 4).alias("x1"), (y + 10).alias("y1"),
        (F.col("l_quantity") / 4).alias("size"), text.alias("text"),
    )


@query("CHK-11")
def two_column_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assembled(block_lines(spark, sf_dir), 600)


HEADER = "length(line) BETWEEN 1 AND 60 AND NOT ends_with(line, '.')"


@query("CHK-12", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
s AS (SELECT *, {HEADER} AS h, sum(({HEADER})::INT) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS section FROM l)
SELECT doc_id, section, max(line) FILTER (h) AS title, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT h), '') AS content FROM s GROUP BY doc_id, section""")
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines without a full stop as headers."""
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    header = F.length("line").between(1, 60) & ~F.endswith("line", F.lit("."))
    return A.sections(lines, "doc_id", "n", "line", header)


@query("JOIN-12", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page_no FROM documents)
SELECT doc_id, page_no::INT AS page_no, length(line)::INT AS source_size, CASE WHEN page_no % 3 <> 2 THEN replace(line, 'e', '3') END AS translated FROM l""")
def page_number_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pages (its lines) with their translations, of which every third is missing."""
    pages = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "line"))
    translated = pages.where("page_no % 3 <> 2").select("doc_id", "page_no", spoken(F.col("line")).alias("translated"))
    return pages.select("doc_id", "page_no", F.length("line").alias("source_size")).join(translated, ["doc_id", "page_no"], "left")


PASSES = [("breaks", r"\n+", " "), ("spaces", " {2,}", " "), ("stops", r" ([,.])", "$1")]


@query("AGG-13 STR-38", r"""WITH a AS (SELECT lang, len(regexp_extract_all(text, '\n+')) AS breaks, regexp_replace(text, '\n+', ' ', 'g') AS t FROM documents),
b AS (SELECT lang, breaks, len(regexp_extract_all(t, ' {2,}')) AS spaces, regexp_replace(t, ' {2,}', ' ', 'g') AS t FROM a), c AS (SELECT lang, breaks, spaces, len(regexp_extract_all(t, ' ([,.])')) AS stops FROM b),
m AS (SELECT lang, unnest(['breaks', 'spaces', 'stops']) AS pass, unnest([breaks, spaces, stops]) AS n FROM c) SELECT lang, pass, sum(n)::BIGINT AS n FROM m GROUP BY lang, pass""")
def cleanup_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pass of a clean-up replaced in each document, added up by language."""
    told = table(spark, sf_dir, "documents").select("lang", F.explode(T.reported(F.col("text"), PASSES)["report"]).alias("pass", "n"))
    return told.groupBy("lang", "pass").agg(F.sum("n").alias("n"))


@query("STR-63 AGG-16", """WITH q AS (SELECT conv_id, text, len(string_split(text, chr(10))) - 1 AS options FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, CASE WHEN options > 2 THEN 'multiple_choice' WHEN options = 2 THEN 'true_false' ELSE 'short_answer' END AS kind, contains(lower(text), 'th') OR contains(lower(text), 'ou') AS known,
CASE WHEN contains(lower(text), 'eau') THEN 'basic' WHEN contains(lower(text), 'ing') THEN 'advanced' ELSE 'intermediate' END AS difficulty FROM q)
SELECT kind, known, difficulty, count(*) AS n, count(*) * 2 AS minutes FROM k GROUP BY ALL""")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' messages as questions, their further lines as options; syllables of the made-up words stand for the words that tell of difficulty."""
    options = F.size(F.split("text", "\n")) - 1
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w))
    kind = F.when(options > 2, "multiple_choice").when(options == 2, "true_false").otherwise("short_answer")
    difficulty = F.when(has("eau"), "basic").when(has("ing"), "advanced").otherwise("intermediate")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(kind.alias("kind"), has("th", "ou").alias("known"), difficulty.alias("difficulty"))
    return rows.groupBy("kind", "known", "difficulty").agg(F.count("*").alias("n"), (F.count("*") * 2).alias("minutes"))


@query("CHK-09", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN text || ' @@@ ' ELSE text END AS t FROM conversations), b AS (SELECT conv_id, bool_or(contains(t, '@@@')) AS odd FROM t GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN odd THEN 'items' ELSE 'batch' END AS way, replace(t, 'e', '3') AS t FROM t JOIN b USING (conv_id)""")
def batches_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages translated (by a stand-in) in one batch a conversation; where the parts don't come back in number, one by one."""
    text = F.when(F.col("turn") % 7 == 5, F.concat("text", F.lit(" @@@ "))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("items"))
    done = rows.select("conv_id", "items", translated_batch(F.col("items.t"), spoken, "@@@").alias("r"))
    return done.select("conv_id", F.col("r.way").alias("way"), F.explode(F.arrays_zip(F.col("items.turn").alias("turn"), F.col("r.parts").alias("t"))).alias("x")).select("conv_id", "x.turn", "way", "x.t")


@query("STR-36", """SELECT doc_id, text || '. See धारा १४, 15 https://x.in/99' AS t FROM documents""")
def devanagari_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return rows.select("doc_id", T.devanagari_digits(F.concat("text", F.lit(". See धारा 14, 15 https://x.in/99"))).alias("t"))


@query("STR-32")
def echoes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with its last line's words said again."""
    rows = docs(spark, sf_dir)
    last = F.array_join(F.slice(F.split(F.element_at(F.split("text", "\n"), -1), " "), F.lit(1), F.lit(20)), " ")
    return rows.select("doc_id", T.without_echoes(F.concat("text", F.lit("\n"), last, F.lit(" "), last, F.lit(" the end the end")), ["end"]).alias("t"))


ENTRIES = """e AS (SELECT user_id AS page, event_id AS row_no, event_type, CASE WHEN event_type = 'error' THEN 'J' || (event_id % 7) END AS judge, CASE WHEN event_type = 'signup' THEN 'H' || (event_id % 3) END AS hall FROM events),
f AS (SELECT *, last_value(judge IGNORE NULLS) OVER w AS j, last_value(hall IGNORE NULLS) OVER w AS h, sum((event_type = 'click')::INT) OVER w AS entry FROM e WINDOW w AS (PARTITION BY page ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
p AS (SELECT page, entry, min(row_no) FILTER (event_type = 'click') AS row_no, arg_min(j, row_no) FILTER (event_type = 'click') AS judge, arg_min(h, row_no) FILTER (event_type = 'click') AS hall, min(row_no) FILTER (event_type = 'view') AS other FROM f WHERE entry > 0 GROUP BY page, entry)"""


@query("RET-09 AGG-14 STM-05 STR-40 STR-43", f"""WITH {ENTRIES}, c AS (SELECT 'WP/' || (row_no % 500) AS case_number, judge, hall, 'P' || row_no AS petitioner, CASE WHEN other IS NOT NULL THEN 'R' || other END AS respondent, page, row_no FROM p),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY case_number ORDER BY page, row_no) = 1)
SELECT case_number, 'WP' AS case_type, judge AS judge_name, hall AS court_hall_no, petitioner, respondent, CASE WHEN respondent IS NOT NULL THEN petitioner || ' vs ' || respondent ELSE petitioner END AS case_title, page, row_no FROM u""")
def cause_list_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of all cause lists: entries under their judge and hall, with the party behind "versus", each case number once, where it stands first."""
    rows = P.forward_filled(cause_rows(spark, sf_dir), "page", ["row_no"], ["judge", "hall"])
    pairs = P.paired(cause_rows(spark, sf_dir), "page", "row_no", F.col("event_type") == "click", F.col("event_type") == "view")
    entries = pairs.join(rows.select("page", F.col("row_no").alias("petitioner_row"), "judge", "hall"), ["page", "petitioner_row"])
    number = F.concat(F.lit("WP/"), (F.col("petitioner_row") % 500).cast("string"))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    cases = entries.select(number.alias("case_number"), F.col("judge").alias("judge_name"), F.col("hall").alias("court_hall_no"), named("P", "petitioner_row").alias("petitioner"), named("R", "respondent_row").alias("respondent"), "page", F.col("petitioner_row").alias("row_no"))
    first = cases.groupBy("case_number").agg(F.min_by(F.struct(*[c for c in cases.columns if c != "case_number"]), F.struct("page", "row_no")).alias("c")).select("case_number", "c.*")
    title = D.case_title(F.col("petitioner"), F.col("respondent"), F.col("case_number"))
    return first.select("case_number", D.case_type(F.col("case_number")).alias("case_type"), "judge_name", "court_hall_no", "petitioner", "respondent", title.alias("case_title"), "page", "row_no")


@query("RET-08 STR-45 STR-46 STR-39", """SELECT doc_id, replace(text, 'e', '3') || ' <strong>धारा</strong> 5 of वादी <br/>: 30 लाख' AS t FROM documents
WHERE NOT regexp_matches(text, '(?i)\\b(plaintiff|section)\\b|</?(strong|em|u)\\s*>|<br|\\d\\s*[mb]illion\\b')""")
def translated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tags, terms and an amount through a translator (a stand-in)."""
    rows = docs(spark, sf_dir).where(~F.col("text").rlike(r"(?i)\b(plaintiff|section)\b|</?(strong|em|u)\s*>|<br|\d\s*[mb]illion\b"))
    raw = F.concat("text", F.lit(" <strong>Section</strong> 5 of Plaintiff <br/>: 3 million"))
    return rows.select("doc_id", N.translated(raw, {"plaintiff": "वादी", "section": "धारा"}, spoken).alias("t"))


@query("RET-07 JOIN-13 STR-15", """WITH d AS (SELECT doc_id AS id, text || '. See (2001) 5 SCC ' || (doc_id * 7 % 900) || ' and AIR 2002 SC ' || doc_id AS draft, '(2001) 5 SCC ' || (doc_id * 7 % 900) AS a, 'AIR 2002 SC ' || doc_id AS b FROM documents),
e AS (SELECT doc_id AS id, 'doc/' || doc_id AS url, lower(text || '; (2001) 5 scc ' || doc_id || '; Air 2002 SC ' || (doc_id + 1)) AS body FROM documents WHERE doc_id % 2 = 1),
c AS (SELECT id, 1 AS pos, a AS claim FROM d UNION ALL SELECT id, 2, b FROM d), h AS (SELECT claim, min(e.id) AS e FROM (SELECT DISTINCT claim FROM c) JOIN e ON contains(body, lower(claim)) GROUP BY claim),
t AS (SELECT c.id, pos, claim, url FROM c LEFT JOIN h USING (claim) LEFT JOIN e ON h.e = e.id),
g AS (SELECT id, count(*)::INT AS n, coalesce(string_agg(claim || ' <- ' || url, '|' ORDER BY pos) FILTER (url IS NOT NULL), '') AS supported, coalesce(string_agg(claim, '|' ORDER BY pos) FILTER (url IS NULL), '') AS unsupported,
bool_or(pos = 1 AND url IS NULL) AS na, bool_or(pos = 2 AND url IS NULL) AS nb FROM t GROUP BY id)
SELECT id, n, supported, unsupported, replace(CASE WHEN na THEN replace(draft, a, '[unverified]') ELSE draft END, CASE WHEN nb THEN b ELSE '' END, CASE WHEN nb THEN '[unverified]' ELSE '' END) AS rewritten FROM d JOIN g USING (id)""")
def checked_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts with two citations each; every second document is evidence for one or two."""
    key = lambda c: c.cast("string")
    rows = docs(spark, sf_dir)
    draft = F.concat("text", F.lit(". See (2001) 5 SCC "), key(F.col("doc_id") * 7 % 900), F.lit(" and AIR 2002 SC "), key(F.col("doc_id")))
    body = F.concat("text", F.lit("; (2001) 5 scc "), key(F.col("doc_id")), F.lit("; Air 2002 SC "), key(F.col("doc_id") + 1))
    evidence = rows.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), key(F.col("doc_id"))).alias("url"), body.alias("body"))
    return checked(rows.select(F.col("doc_id").alias("id"), draft.alias("draft")), evidence)
