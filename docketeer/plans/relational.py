"""Filters, joins, aggregates, set operations and scalar arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.operators import ingest as I
from docketeer.operators import retrieval as R
from docketeer.operators.substring_join import contained
from docketeer.plans.registry import query
from docketeer.plans.retrieval import CASES
from docketeer.sources.tables import judgments, table


@query("SRC-01 SRC-02", f"WITH {CASES} SELECT id, court, year, citation FROM cases WHERE id = 42")
def case_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).where("id = 42").select("id", "court", "year", "citation")


@query("SRC-05", "SELECT DISTINCT source AS collection_id FROM documents")
def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("collection_id")).distinct()


@query("SRC-07", "SELECT doc_id, source FROM documents WHERE NOT (source = 'src1' OR (source = 'src2' AND doc_id IN (2, 22, 42)))")
def delete_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return I.remove(docs, (F.col("source") == "src1") | ((F.col("source") == "src2") & F.col("doc_id").isin(2, 22, 42)))


@query("SRC-08", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id LIMIT 100")
def scroll_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the rows that agree in all given fields, in a total order."""
    return R.filter_chunks(table(spark, sf_dir, "documents"), source="src3", lang="en").select("doc_id", "source", "lang").orderBy("doc_id").limit(100)


@query("SRC-13 SRC-16", """WITH p AS (SELECT page_id, url || ['.pdf', '.PNG', '.docx', '', '.tar.gz', '.md'][page_id % 6 + 1] AS path FROM pages), e AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$', 0)) AS ext FROM p)
SELECT page_id, CASE ext WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' WHEN '.html' THEN 'text/html' WHEN '.md' THEN 'text/markdown' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime,
CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.png' THEN 'image' END AS parser FROM e""")
def mime_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by extension for paths made of the page addresses."""
    pages = table(spark, sf_dir, "pages")
    endings = F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".docx", "", ".tar.gz", ".md")])
    path = F.concat("url", F.element_at(endings, (F.col("page_id") % 6 + 1).cast("int")))
    return pages.select("page_id", path.alias("path")).select("page_id", I.mime_type(F.col("path")).alias("mime"), I.source_type(F.regexp_replace("path", "^https?://", "")).alias("parser"))


@query("SRC-22", "SELECT doc_id, coalesce(CASE WHEN length(source) >= 100 THEN source END, CASE WHEN length(text) >= 100 THEN text END, CASE WHEN length(repeat(text, 3)) >= 100 THEN repeat(text, 3) END) AS chosen FROM documents")
def extraction_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = [F.col("source"), F.col("text"), F.repeat("text", F.lit(3))]
    return table(spark, sf_dir, "documents").select("doc_id", I.first_long_enough(*candidates).alias("chosen"))


@query("SRC-20 SRC-21", "WITH k AS (SELECT doc_id, 'ocr-cache/gemini/markdown/' || lang || '/' || sha256(text) || '.md' AS cache_key FROM documents) SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM k WHERE doc_id % 3 = 0) AS hit FROM k")
def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", I.cache_key(F.col("text"), "gemini", "markdown", F.col("lang")).alias("cache_key"))
    return I.cache_split(keyed, keyed.where("doc_id % 3 = 0"), "cache_key")


@query("SRC-25 JOIN-09", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that an insert under the orders' keys would add."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    old = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return I.insert_ignore(new, old, ["k"]).withColumnRenamed("k", "c_custkey")


@query("SRC-26 SRC-27", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'T' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN 'formal' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dynamic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update whose null fields leave the old values."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("c_name"), F.when(F.col("c_custkey") % 10 == 0, "formal").alias("c_mktsegment"))
    return I.updated(old, new, "c_custkey", ["c_name", "c_mktsegment"])


@query("JOIN-04", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("JOIN-08", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON lower('supplier ' || c.c_custkey) = lower('Supplier ' || s.s_suppkey)")
def case_insensitive_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat_ws(" ", F.lit("supplier"), F.col("c_custkey").cast("string"))).alias("name"))
    known = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.concat_ws(" ", F.lit("Supplier"), F.col("s_suppkey").cast("string"))).alias("name"))
    return names.join(known, "name").select("c_custkey", "s_suppkey")


@query("JOIN-10 JOIN-11", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text WHEN l.toxic = 1 THEN 'corrected ' || d.doc_id WHEN trim(CASE WHEN l.quality = 1 THEN reverse(d.text) ELSE ' ' END) = '' THEN d.text ELSE reverse(d.text) END AS final
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def translation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's correction, else the translation, else the source where it is missing or blank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"))
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    translated = F.when(F.col("quality") == 1, F.reverse("source_text")).otherwise(F.lit(" "))
    corrected = F.when(F.col("toxic") == 1, F.concat(F.lit("corrected "), F.col("doc_id").cast("string")))
    return joined.select("doc_id", F.coalesce(corrected, F.when(F.col("quality").isNotNull(), F.nullif(F.when(F.trim(translated) != "", translated), F.lit(""))), "source_text").alias("final"))


@query("JOIN-13 STR-15 SORT-15", """WITH c AS (SELECT item_id, lower(string_split(text, '.')[1]) AS anchor FROM benchmark), h AS (SELECT doc_id, lower(text) AS hay FROM documents)
SELECT c.item_id, min(doc_id) AS first_doc, count(doc_id) AS n_docs FROM c LEFT JOIN h ON contains(hay, anchor) GROUP BY c.item_id""")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the documents that contain its first sentence as an anchor; the first one supports it."""
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring_index("text", ".", 1)).alias("anchor"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    met = contained(docs, claims.select(F.col("anchor").alias("term"))).select(F.col("id").alias("doc_id"), F.col("term").alias("anchor"))
    hits = met.join(claims, "anchor").select("doc_id", "item_id")
    found = hits.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count("doc_id").alias("n_docs"))
    return claims.join(found, "item_id", "left").select("item_id", "first_doc", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("JOIN-17", """WITH b AS (SELECT p_brand AS term, min(p_type) AS t FROM part GROUP BY 1), l AS (SELECT p_brand AS term, max(p_type) AS t FROM part WHERE p_size > 25 GROUP BY 1), n AS (SELECT p_brand AS term, min(p_name) AS t FROM part WHERE p_size = 50 GROUP BY 1)
SELECT term, coalesce(n.t, l.t, b.t) AS translation FROM b LEFT JOIN l USING (term) LEFT JOIN n USING (term)""")
def glossary_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    layer = lambda rows, value: rows.groupBy(F.col("p_brand").alias("term")).agg(value.alias("translation"))
    return I.layered(layer(part, F.min("p_type")), layer(part.where("p_size > 25"), F.max("p_type")), layer(part.where("p_size = 50"), F.min("p_name")))


@query("AGG-01", "SELECT DISTINCT source AS court FROM documents")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("court").distinct().orderBy("court")


@query("AGG-02", f"WITH {CASES} SELECT min(year) AS first_year, max(year) AS last_year FROM cases")
def min_max_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("AGG-03 ARR-02", f"WITH {CASES} SELECT DISTINCT unnest(judges) AS judge FROM cases ORDER BY judge LIMIT 500")
def distinct_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select(F.explode("judges").alias("judge")).distinct().orderBy("judge").limit(500)


@query("AGG-04", "SELECT source AS file_id, count(*) AS n_chunks, min(doc_id) AS indexed_at FROM documents GROUP BY source")
def collection_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_status(table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("indexed_at")))


@query("AGG-05", "SELECT r.file_id, count(d.doc_id) AS n_chunks, CASE WHEN count(d.doc_id) > 0 THEN 'INDEXED' ELSE 'NOT_FOUND' END AS status FROM (SELECT 'src' || s_suppkey AS file_id FROM supplier) r LEFT JOIN documents d ON d.source = r.file_id GROUP BY r.file_id")
def requested_ids_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("file_id"))
    return I.requested_status(wanted, table(spark, sf_dir, "documents").select(F.col("source").alias("file_id")))


@query("AGG-13", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS lines, count_if(l_discount > 0.05)::BIGINT AS discounted, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def counter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the same counters, added field by field."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count("*").alias("n"))


@query("AGG-16", "SELECT role, count(*) AS n, count(*) * 2 AS minutes FROM conversations GROUP BY role")
def question_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), (F.count("*") * 2).alias("minutes"))


@query("AGG-17", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n---\n").alias("context"))


@query("SET-02 SORT-12", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS pos FROM labels ORDER BY pos LIMIT 100")
def priority_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The high bucket before the low one, each in its order."""
    return R.ranked(table(spark, sf_dir, "labels").select("doc_id", "quality"), [F.desc("quality"), F.asc("doc_id")], 100, "pos")


@query("SET-03 SET-05", "SELECT doc_id, lang FROM documents EXCEPT SELECT doc_id, 'en' FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").exceptAll(table(spark, sf_dir, "labels").select("doc_id", F.lit("en"))).distinct()


@query("SET-04", "WITH i AS (SELECT doc_id, 'internal' AS origin FROM documents WHERE n_chars > 30000 ORDER BY doc_id LIMIT 20), w AS (SELECT page_id, 'web' FROM pages WHERE (SELECT count(*) FROM i) < 5 ORDER BY page_id LIMIT 10) SELECT * FROM i UNION ALL SELECT * FROM w")
def internal_else_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web results join in when there are under five internal ones."""
    internal = table(spark, sf_dir, "documents").where("n_chars > 30000").orderBy("doc_id").limit(20).select("doc_id", F.lit("internal").alias("origin"))
    web = table(spark, sf_dir, "pages").where(internal.agg(F.count("*")).scalar() < 5).orderBy("page_id").limit(10)
    return internal.unionByName(web.select(F.col("page_id").alias("doc_id"), F.lit("web").alias("origin")))


@query("MATH-07 CHK-13", "SELECT c_custkey, greatest(1, least(c_nationkey, 5))::INT AS n_sources, greatest(6, 2 * c_nationkey)::INT AS n_candidates, ceil(c_custkey / 500.0)::BIGINT AS batch FROM customer")
def clamp_and_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.lit(1), F.least(n, F.lit(5))).alias("n_sources"), F.greatest(F.lit(6), 2 * n).alias("n_candidates"), F.ceil(F.col("c_custkey") / 500).alias("batch"))


@query("JSON-02 JSON-06", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("JSON-03", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events")
def enum_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("kind"))


@query("ARR-03 ARR-04 ARR-05", "WITH a AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS x FROM orders GROUP BY 1) SELECT o_custkey, array_to_string([('[' || i || '] ' || x[i]) FOR i IN range(1, least(len(x), 3) + 1)], chr(10)) AS numbered, len(x) AS n FROM a")
def numbered_first_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three entries of each list as numbered lines."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    lines = F.transform(F.slice("x", 1, 3), lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["o_orderpriority"]))
    return rows.select("o_custkey", F.array_join(lines, "\n").alias("numbered"), F.size("x").cast("long").alias("n"))


@query("DATE-01 DATE-06", "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS short, strftime(o_orderdate, '%d %B, %Y') AS long_form FROM orders")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("short"), F.date_format("o_orderdate", "dd MMMM, yyyy").alias("long_form"))


@query("FLT-14", "SELECT doc_id, count(*) AS pages, max(length(p)) < 50 AS image_only, sum(length(p)) / greatest(count(*), 1) < 100 AS scanned FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id")
def scanned_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, their lines as pages: none has fifty characters, or they have under a hundred on average."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    n = F.length("p")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), (F.max(n) < 50).alias("image_only"), (F.sum(n) / F.greatest(F.count("*"), F.lit(1)) < 100).alias("scanned"))


@query("SRC-31", "SELECT doc_id, unnest(range(0, (n_chars // 500 + 1)::BIGINT, 10)) AS first_page, (n_chars // 500 + 1)::BIGINT AS pages FROM documents")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ten pages of each document."""
    pages = (F.floor(F.col("n_chars") / 500) + 1).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1, F.lit(10).cast("long"))).alias("first_page"), "pages")
