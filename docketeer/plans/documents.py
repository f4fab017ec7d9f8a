"""Whole documents: types, clean-up, sentinels, requests, rendering, semantic chunks, collections as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions import documents as N
from docketeer.operators import chunking as C
from docketeer.operators import ingest as I
from docketeer.operators import layout as Y
from docketeer.plans.registry import query
from docketeer.plans.texts import doc_key, docs, planted
from docketeer.sources.shared import kept, scratch
from docketeer.sources.tables import table


@query("STR-68", r"""WITH t AS (SELECT doc_id, ['Second Edition, published by X', 'Chapter 3' || chr(10), 'chapter 1 chapter 2 chapter 3 ', ''][doc_id % 4 + 1] || text AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'BOOK' WHEN 2 THEN 'BOOK' WHEN 1 THEN 'CHAPTER' ELSE CASE WHEN doc_id % 7 = 0 THEN 'BOOK' ELSE 'DOCUMENT' END END AS kind FROM t""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.element_at(F.array(F.lit("Second Edition, published by X"), F.lit("Chapter 3\n"), F.lit("chapter 1 chapter 2 chapter 3 "), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    size = F.when((F.col("doc_id") % 4 == 3) & (F.col("doc_id") % 7 == 0), 6_000_000).otherwise(1000)
    return docs(spark, sf_dir).select("doc_id", N.content_type(F.concat(starts, "text"), size).alias("kind"))


@query("STR-67", r"""WITH t AS (SELECT doc_id, 'CHAPTER ' || (doc_id % 30) || ': ' || ['Worked cases', 'Review', 'Law'][doc_id % 3 + 1] || ' ' || text AS t FROM documents)
SELECT doc_id, TRY_CAST(regexp_extract(t, '(?i)\bchapter\s+(\d+)', 1) AS INT) AS chapter, CASE WHEN regexp_matches(lower(t), 'example|sample|worked|demonstration|illustration|case study') THEN 'example' WHEN regexp_matches(lower(t), 'exercise|problem|question|checkpoint|practice|review|test yourself') THEN 'question' ELSE 'concept' END AS kind FROM t""")
def chapter_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind a chapter's heading."""
    heading = F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 30).cast("string"), F.lit(": "), F.element_at(F.array(F.lit("Worked cases"), F.lit("Review"), F.lit("Law")), (F.col("doc_id") % 3 + 1).cast("int")))
    title = F.concat(heading, F.lit(" "), "text")
    return docs(spark, sf_dir).select("doc_id", N.chapter_number(title).alias("chapter"), N.header_kind(title).alias("kind"))


@query("STR-49", r"""WITH t AS (SELECT doc_id, '$\circ$ item' || chr(10) || text || chr(10) || '  $\bullet$ \text{sum} $40K+$ of\quad ' || doc_id AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^(\s*)\$\\(?:circ|bullet|cdot)\$\s*', '\1- ', 'g'), '\\text\{([^}]*)\}', '\1', 'g'), '\$([^$\n]*)\$', '\1', 'g'), '\\[a-zA-Z]+', '', 'g') AS t FROM t""")
def latex_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    raw = F.concat(F.lit("$\\circ$ item\n"), "text", F.lit("\n  $\\bullet$ \\text{sum} $40K+$ of\\quad "), doc_key())
    return rows.select("doc_id", N.without_latex(raw).alias("t"))


@query("STR-51", r"""WITH t AS (SELECT doc_id, '<think>why' || chr(10) || '</think>--- BEGIN DOCUMENT ---' || chr(10) || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || '--- END DOCUMENT ---' AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g'), '-{2,}\s*(?:BEGIN|END)\s+DOCUMENT\s*-{2,}', '', 'g'), '(?m)^```\w*\s*$\n?', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM t""")
def reply_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a model's replies."""
    raw = F.concat(F.lit("<think>why\n</think>--- BEGIN DOCUMENT ---\n```text\n"), "text", F.lit("\n```\n--- END DOCUMENT ---"))
    return docs(spark, sf_dir).select("doc_id", N.without_reasoning(raw).alias("t"))


@query("FLT-16", "SELECT doc_id, coalesce(regexp_matches(string_split(text, ' ')[1], '^[a-zA-Z0-9_-]+$'), false) AS valid FROM documents")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first word as the name of a folder."""
    return docs(spark, sf_dir).select("doc_id", N.valid_folder(F.substring_index("text", " ", 1)).alias("valid"))


@query("FLT-19 FLT-20 JSON-04", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment, 2 + (c_custkey % 2 = 0)::INT AS n FROM customer")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New metadata over old; nulls and blanks change nothing."""
    old = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    new = F.create_map(F.lit("name"), F.lit(None).cast("string"), F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, "new"), F.lit("x"), F.when(F.col("c_custkey") % 2 == 0, "1").otherwise(" "))
    both = N.filled(N.merged(old, N.filled(new)))
    return table(spark, sf_dir, "customer").select("c_custkey", both.alias("m")).select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.size("m").alias("n"))


@query("STR-18 STR-19", "SELECT doc_id, length(trim(text)) >= 500 AS ok FROM documents")
def draft_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", N.long_enough(F.col("text")).alias("ok"))


@query("STR-58 SORT-13", "SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN '<strong>' || (CASE WHEN l_linestatus = 'F' THEN '<em>' || l_linenumber || '&lt;</em>' ELSE l_linenumber || '&lt;' END) || '</strong>' ELSE (CASE WHEN l_linestatus = 'F' THEN '<em>' || l_linenumber || '&lt;</em>' ELSE l_linenumber || '&lt;' END) END, '' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS html FROM lineitem GROUP BY l_orderkey")
def spans_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans in reading order."""
    span = F.struct("l_linenumber", F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("r"), F.concat(F.col("l_linenumber").cast("string"), F.lit("<")).alias("text"), (F.col("l_linestatus") == "F").alias("italic"), (F.col("l_returnflag") == "R").alias("bold"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("spans")).select("l_orderkey", N.span_html(F.col("spans")).alias("html"))


@query("STR-59 STR-60", "SELECT s_suppkey, '<!-- cause-title:start -->' || CASE WHEN s_suppkey % 5 = 0 THEN '[Party Name]' ELSE s_name END || CASE WHEN s_suppkey % 2 = 0 THEN ', Age: ' || (s_suppkey % 60) ELSE '' END || ' ... Respondent' || CASE WHEN s_nationkey > 10 THEN ' No. ' || (s_suppkey % 3) ELSE '' END || '<!-- cause-title:end -->' || chr(10) || chr(10) || 'Body' AS draft FROM supplier")
def cause_title_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    party = N.party_block(F.when(key % 5 != 0, F.col("s_name")), F.when(key % 2 == 0, key % 60), F.lit("Respondent"), key % 3, F.when(F.col("s_nationkey") > 10, 3).otherwise(1))
    draft = N.with_cause_title(N.with_cause_title(F.lit("Body"), party), party)
    return table(spark, sf_dir, "supplier").select("s_suppkey", draft.alias("draft"))


@query("STR-45 SORT-14 RET-08", "SELECT doc_id, text || ' The [__0000__] [__0001__] ' || doc_id || ' of the act' AS frozen, text || ' The वादी under धारा ' || doc_id || ' of the act' AS t FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(plaintiff|section)\\b')")
def glossary_freeze_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms frozen before a translator and restored behind it; the longer term wins."""
    terms = {"plaintiff": "वादी", "section": "धारा", "under section": "under धारा"}
    rows = planted(spark, sf_dir, F.lit(" The Plaintiff under Section "), doc_key(), F.lit(" of the act"))
    rows = rows.where(F.size(F.regexp_extract_all("text", F.lit(r"(?i)\b(plaintiff|section)\b"), F.lit(0))) == 2).select("doc_id", N.freeze(F.col("text"), terms).alias("f"))
    spaced = F.regexp_replace("f.text", r"\[__(\d{4})__\]", "[_ _$1_ _]")
    return rows.select("doc_id", F.col("f.text").alias("frozen"), N.restore(spaced, F.col("f.held")).alias("t"))


@query("CHK-04 WIN-05")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(docs(spark, sf_dir), N.semantic_chunks)


@query("CHK-09", "SELECT conv_id, count(*) AS n FROM conversations WHERE NOT contains(text, chr(10) || '@@@' || chr(10)) GROUP BY conv_id")
def separator_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages joined with a separator and split again: as many parts as there were."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n@@@\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("t")).select("conv_id", F.size(F.split("t", "\n@@@\n")).cast("long").alias("n"))


@query("CHK-11", "SELECT l_orderkey, round(l_linenumber * 5.0 / 6)::INT AS band, count(*) AS n, string_agg(l_suppkey::VARCHAR, ' ' ORDER BY l_suppkey, l_partkey) AS line FROM lineitem GROUP BY 1, 2")
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one height as a line, left to right."""
    band = F.round(F.col("l_linenumber") * 5.0 / 6).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_partkey"))).alias("s"), F.count("*").alias("n"))
    return rows.select("l_orderkey", "band", "n", F.array_join(F.transform("s", lambda r: r["l_suppkey"].cast("string")), " ").alias("line"))


@query("WIN-09", "SELECT conv_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user', false) AND length(text) <= 80 AS author FROM conversations")
def author_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short blocks right behind a title (a user's message stands for one)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    rows = Y.with_previous(rows, "conv_id", ["turn"], "role", "before")
    return rows.select("conv_id", "turn", (F.coalesce(F.col("before") == "user", F.lit(False)) & (F.col("n") <= 80)).alias("author"))


@query("JOIN-02", "SELECT a.doc_id, a.lang, l.quality FROM documents a JOIN labels l ON a.doc_id = l.doc_id")
def raster_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("JOIN-16", "WITH e AS (SELECT l_orderkey, l_linenumber, l_suppkey AS s, l_suppkey + 5 AS t FROM lineitem WHERE l_linenumber > 2), k AS (SELECT l_orderkey, l_suppkey AS a, l_suppkey + 3 AS b FROM lineitem WHERE l_linenumber <= 2) SELECT l_orderkey, l_linenumber, s FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = e.l_orderkey AND NOT (e.t <= k.a OR k.b <= e.s))")
def edits_outside_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that touch no protected span of their text."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"))
    edits = rows.where("l_linenumber > 2").alias("e")
    spans = rows.where("l_linenumber <= 2").alias("k")
    touch = (F.col("e.l_orderkey") == F.col("k.l_orderkey")) & ~((F.col("e.s") + 5 <= F.col("k.s")) | (F.col("k.s") + 3 <= F.col("e.s")))
    return edits.join(spans, touch, "left_anti").select("l_orderkey", "l_linenumber", "s")


@query("JSON-01", "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("payload"))


@query("JSON-05", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) + 1 AS position, event_type AS label FROM events")
def json_restructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON taken apart, changed and written anew."""
    parsed = F.from_json("props", "k int")
    again = F.to_json(F.struct((parsed["k"] + 1).alias("position"), F.col("event_type").alias("label")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(again, "position int, label string").alias("j")).select("event_id", "j.position", "j.label")


@query("SRC-03 SRC-04 SRC-06 SRC-05", "SELECT 'c' || (doc_id % 4) AS collection_id, count(*) AS n FROM documents WHERE doc_id % 4 < 2 GROUP BY 1")
def collection_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a table partitioned by collection, in two appends, and two collections read back."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("collection_id"), "doc_id")
    with scratch(spark) as path:
        rows.where("doc_id % 2 = 0").write.mode("overwrite").partitionBy("collection_id").parquet(path)
        rows.where("doc_id % 2 = 1").write.mode("append").partitionBy("collection_id").parquet(path)
        stored = spark.read.schema("doc_id long, collection_id string").parquet(path)
        return kept(stored.where(F.col("collection_id").isin("c0", "c1")).groupBy("collection_id").agg(F.count("*").alias("n")))


@query("SRC-28", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0")
def clear_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.remove(table(spark, sf_dir, "conversations").select("conv_id", "turn"), F.col("conv_id") % 5 == 0)


@query("SRC-09 SRC-10", "SELECT doc_id, quality FROM labels")
def feedback_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback appended as JSON lines and read with its schema; broken and blank lines don't count."""
    with scratch(spark) as path:
        table(spark, sf_dir, "labels").select("doc_id", "quality").write.mode("overwrite").json(path)
        spark.range(1).select(F.lit("  ").alias("value")).write.mode("append").text(path)
        return kept(spark.read.schema("doc_id long, quality int").option("mode", "DROPMALFORMED").json(path).where("doc_id IS NOT NULL"))
