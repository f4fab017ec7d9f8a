"""Text expressions and chunks on the documents, with patterns planted where the documents have none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions import legal as L
from docketeer.functions import text as T
from docketeer.operators import chunking as C
from docketeer.plans.registry import query
from docketeer.sources.tables import spread, table


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns or ("text",)))


def planted(spark: SparkSession, sf_dir: str, *parts: object) -> DataFrame:
    """Documents with something appended to the text."""
    return docs(spark, sf_dir).withColumn("text", F.concat("text", *parts))


def doc_key() -> Column:
    """The document's id as text."""
    return F.col("doc_id").cast("string")


@query("STR-03 STR-04", r"""WITH t AS (SELECT doc_id, text || ' (' || (1990 + doc_id % 35) || ') 5 SCC ' || doc_id || '; AIR 2001 SC ' || doc_id || ' (2020) 5 SCC 1 (2020) 5 SCC 1.' AS text FROM documents)
SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS citations, (1990 + doc_id % 35)::INT AS last_year FROM (SELECT doc_id, text, list_filter(list_concat(regexp_extract_all(text, '(?i)\(\s*\d{4}\s*\)\s*\d+\s+SCC\s+\d+'), regexp_extract_all(text, '(?i)\bAIR\s+\d{4}\s+(?:SC|Del|Bom|Cal|Mad|Kar|Guj|Ker|All|Raj|Pat|Ori)\s+\d+')), lambda x: true) AS found,
list_filter(found, lambda x, i: list_position(found, x) = i) AS list_distinct_ordered FROM t)""")
def citation_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporter citations planted in the documents, distinct and in order."""
    year = (F.col("doc_id") % 35 + 1990).cast("string")
    rows = planted(spark, sf_dir, F.lit(" ("), year, F.lit(") 5 SCC "), doc_key(), F.lit("; AIR 2001 SC "), doc_key(), F.lit(" (2020) 5 SCC 1 (2020) 5 SCC 1."))
    return rows.select("doc_id", F.array_join(L.all_matches(F.col("text"), *L.CITATIONS[:2]), "|").alias("citations"), year.cast("int").alias("last_year"))


@query("STR-03", r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text || ' of 1' || (800 + doc_id % 300) || ' a', '\b((?:19|20)\d{2})\b', 1), '') AS INT) AS year FROM documents")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit(" of 1"), (F.col("doc_id") % 300 + 800).cast("string"), F.lit(" a"))
    return rows.select("doc_id", L.first_year(F.col("text")).alias("year"))


@query("JOIN-14 AGG-19", r"""WITH t AS (SELECT doc_id, '(2001) 5 SCC ' || doc_id AS cite, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' (2001) 5 SCC ' || doc_id END AS corpus FROM documents)
SELECT count(*) AS n, count_if(NOT contains(corpus, cite))::BIGINT AS unverified FROM t""")
def citation_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many citations the tool results don't hold."""
    cite = F.concat(F.lit("(2001) 5 SCC "), doc_key())
    rows = docs(spark, sf_dir).withColumns({"cites": F.array(cite), "corpus": F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" "), cite))})
    missing = F.size(L.grounded(F.col("cites"), F.col("corpus")))
    return rows.agg(F.sum(F.size("cites")).alias("n"), F.sum(missing).alias("unverified"))


@query("STR-17", r"""WITH t AS (SELECT doc_id, text || ' 1234-5678-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || chr(10) || 'Aadhaar no. 98765432' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || chr(10) || 'ref 987654321234' AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(text, '\b\d{4}[- ]\d{4}[- ](\d{4})\b', 'XXXX-XXXX-\1', 'g'), '(?i)(aadhaar|आधार|uid|uidai)([^\n]{0,40}?)\b\d{8}(\d{4})\b', '\1\2XXXX-XXXX-\3', 'g') AS masked FROM t""")
def aadhaar_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    rows = planted(spark, sf_dir, F.lit(" 1234-5678-"), last, F.lit("\nAadhaar no. 98765432"), last, F.lit("\nref 987654321234"))
    return rows.select("doc_id", L.mask_identity(F.col("text")).alias("masked"))


@query("STR-16 SORT-16", r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' [Loan Amount] {{x}} ____ tbd [Loan Amount]' ELSE '' END AS text FROM documents)
SELECT doc_id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), '|') AS placeholders FROM (SELECT doc_id, list_concat(list_concat(regexp_extract_all(text, '\[[A-Z][A-Za-z][A-Za-z \-/]{1,38}\]'), regexp_extract_all(text, '\{\{[^}]{1,60}\}\}')),
  list_concat(regexp_extract_all(text, '_{4,}'), regexp_extract_all(text, '(?i)\b(?:XXXX|TBD|TO BE FILLED|TO BE DECIDED|NOT PROVIDED|INSERT HERE)\b'))) AS found FROM t)""")
def placeholder_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.when(F.col("doc_id") % 5 == 0, " [Loan Amount] {{x}} ____ tbd [Loan Amount]").otherwise(""))
    return rows.select("doc_id", F.array_join(L.placeholders(F.col("text")), "|").alias("placeholders"))


@query("STR-26", "SELECT doc_id, translate(text || '‘a’ “b” – — «c»', '‘’‚“”„«»–', '''''''\"\"\"\"\"-') AS text FROM documents")
def smart_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, F.lit("‘a’ “b” – — «c»")).select("doc_id", T.plain_quotes(F.col("text")).alias("text"))


@query("STR-25", r"SELECT doc_id, regexp_replace(text || chr(8203) || 'x' || chr(7) || chr(65279), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]', '', 'g') AS text, (length(text || chr(8203) || 'x' || chr(7) || chr(65279)) - length(regexp_replace(text || chr(8203) || 'x' || chr(7) || chr(65279), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}]', '', 'g')))::BIGINT AS removed FROM documents")
def control_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit("​x\u0007﻿"))
    clean = T.without_controls(F.col("text"))
    return rows.select("doc_id", clean.alias("text"), (F.length("text") - F.length(clean)).cast("long").alias("removed"))


@query("STR-33", r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, ' ', '  '), '[ \t]{2,}', ' ', 'g'), '(?m)[ \t]+$', '', 'g') AS text FROM documents")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.collapsed_spaces(F.replace("text", F.lit(" "), F.lit("  "))).alias("text"))


@query("STR-27 STR-28 STR-38")
def source_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning passes."""
    rows = planted(spark, sf_dir, F.lit(" ######## exam-\nple  x "))
    return rows.select("doc_id", T.cleaned(F.col("text")).alias("text"))


@query("STR-22", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("STR-22", r"SELECT p_partkey, replace(p_name, ' ', '') || ' v1.md' AS filename FROM part")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.replace("p_name", F.lit(" "), F.lit("?")), F.lit(' "v1"/.. .MD'))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_filename(F.regexp_replace(title, r"/\.\. ", "")).alias("filename"))


@query("STR-01", "SELECT conv_id, turn, 'IPC (Indian Penal Code) and IPC of the SC (Supreme Court) ' || replace(replace(text, 'Art', ''), 'Sec', '') AS query FROM conversations")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations planted before the messages."""
    own = F.replace(F.replace("text", F.lit("Art"), F.lit("")), F.lit("Sec"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.expanded(F.concat(F.lit("IPC and IPC of the SC "), own)).alias("query"))


@query("STR-02", """WITH c AS (SELECT conv_id, turn, lower(['What is ', 'show me ', 'how to ', ''][turn % 4 + 1] || text) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'what is|define|explain|meaning of|concept of|understanding|tell me about') THEN 'concept' WHEN regexp_matches(q, 'example|show me|demonstrate|illustration|sample|case study') THEN 'example'
WHEN regexp_matches(q, '^how (do|to|can)|^solve|^calculate|^find|^determine|practice|exercise|problem') THEN 'question' END AS intent FROM c""")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.element_at(F.array(*[F.lit(s) for s in ("What is ", "show me ", "how to ", "")]), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intent(F.concat(starts, "text")).alias("intent"))


@query("STR-14", r"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN array_to_string(string_split(text, ' ')[1:3], ' ') WHEN 1 THEN 'Thank you!' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, trim(t) = '' OR turn % 3 = 1 OR (len(regexp_split_to_array(trim(t), '\s+')) <= 3 AND NOT contains(t, '?') AND NOT regexp_matches(lower(t), 'section|act|court|case|law|ipc|crpc|bns|bnss|bsa|evidence|constitution|article|writ|bail|petition|appeal|judgment|judgement|supreme|high court')) AS trivial FROM c""")
def trivial_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    message = F.when(F.col("turn") % 3 == 0, short).when(F.col("turn") % 3 == 1, "Thank you!").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_trivial(message).alias("trivial"))


@query("STR-11", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'LiveLaw' WHEN 1 THEN 'Bar and Bench' ELSE 'Web' END AS label FROM pages")
def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.LiveLaw.in/?r="), "url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://barandbench.com/"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.domain_label(url).alias("label"))


@query("FLT-12", "SELECT page_id, NOT regexp_matches(lower(url || ['/Blog/1', '/x', ''][page_id % 3 + 1]), '/blog|/article|/column|/news|/newsline') AND NOT (page_id % 7 = 0) AS is_judgment FROM pages")
def judgment_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.element_at(F.array(F.lit("/Blog/1"), F.lit("/x"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))
    title = F.when(F.col("page_id") % 7 == 0, "An Editorial").otherwise("X v. Y")
    return table(spark, sf_dir, "pages").select("page_id", T.is_judgment_page(url, title).alias("is_judgment"))


@query("STR-12", "SELECT doc_id, length(trim(text)) < 200 AS paywalled FROM documents")
def paywall_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", (F.length(F.trim("text")) < 200).alias("paywalled"))


@query("STR-09 STR-55", "SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END AS shown, CASE WHEN length(text) > 1000 THEN left(text, 500) || chr(10) || '[...]' || chr(10) || right(text, 500) ELSE text END AS ends FROM documents")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.shortened(F.col("text"), 800).alias("shown"), T.middle_cut(F.col("text"), 1000).alias("ends"))


@query("STR-07 STR-08", "SELECT doc_id, round(doc_id % 100 / 100.0::DOUBLE, 2) AS relevance, source AS file_id, (doc_id % 9)::INT AS page, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents WHERE NOT contains(text, '---')")
def rag_format_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context blocks as they are written for a model, and read back from there."""
    rows = docs(spark, sf_dir, "text", "source").where(~F.col("text").contains("---"))
    block = F.format_string("[Indexed chunk %d] [Relevance: %.2f] [File id: %s] [Page: %d]\n%s", "doc_id", (F.col("doc_id") % 100) / 100, "source", F.col("doc_id") % 9, "text")
    parse = lambda pattern: F.regexp_extract("block", pattern, 1)
    body = F.regexp_extract("block", r"(?s)^[^\n]*\n(.*)$", 1)
    return rows.select(block.alias("block")).select(
        parse(r"\[Indexed chunk (\d+)\]").cast("long").alias("doc_id"), parse(r"\[Relevance: ([\d.]+)\]").cast("double").alias("relevance"),
        parse(r"\[File id: ([^\]]+)\]").alias("file_id"), parse(r"\[Page: (\d+)\]").cast("int").alias("page"), T.shortened(body, 200).alias("preview"),
    )


@query("STR-06 STR-10", "SELECT page_id, 'Case ' || page_id AS case_name, url, (1990 + page_id % 35)::INT AS year FROM pages")
def web_citation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation blocks of a search tool's output, written and parsed."""
    pages = table(spark, sf_dir, "pages")
    block = F.concat(F.lit("[W"), F.col("page_id").cast("string"), F.lit("] Case "), F.col("page_id").cast("string"), F.lit("\nSource: Web\nURL: "), F.col("url"), F.lit("\nYear: "), (F.col("page_id") % 35 + 1990).cast("string"))
    split = F.explode(F.split(F.concat(block, F.lit("\n\n")), r"(?=\[W\d+\]\s)"))
    rows = pages.select(split.alias("b")).where(F.trim("b") != "")
    field = lambda name: F.trim(F.regexp_extract("b", rf"(?m)^{name}:\s*(.+)$", 1))
    return rows.select(F.regexp_extract("b", r"^\[W(\d+)\]", 1).cast("long").alias("page_id"), F.regexp_extract("b", r"^\[W\d+\]\s*(.+)", 1).alias("case_name"), field("URL").alias("url"), field("Year").cast("int").alias("year"))


@query("STR-48", "SELECT doc_id, '{\"k\": ' || doc_id || '}' AS body FROM documents")
def code_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit('```json\n{"k": '), doc_key(), F.lit("}\n```\n"))
    return docs(spark, sf_dir).select("doc_id", T.code_fence_stripped(fenced).alias("body"))


@query("FLT-10 FLT-11 STR-54", r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a.b@c.org' WHEN 1 THEN '--- //' WHEN 2 THEN 'https://x.org/a' WHEN 3 THEN '12-166' ELSE text END AS t FROM documents)
SELECT doc_id, length(trim(t)) > 2 AND NOT regexp_matches(trim(t), '^[\w.+-]+@[\w.-]+$|^https?://\S+$') AND length(regexp_replace(trim(t), '[^\p{L}\p{N}]', '', 'g')) >= 3 AS needed, regexp_matches(t, '^[0-9./,:()\-]{1,16}$') AND regexp_matches(t, '[0-9]') AS compact FROM t""")
def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("a.b@c.org"), F.lit("--- //"), F.lit("https://x.org/a"), F.lit("12-166"), F.col("text"))
    rows = docs(spark, sf_dir).withColumn("t", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))
    return rows.select("doc_id", T.needs_translation(F.col("t")).alias("needed"), T.numeric_compact(F.col("t")).alias("compact"))


@query("MATH-11 FLT-07", r"SELECT doc_id, letters >= 4 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(1, letters) > 0.85 AS caps, length(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{P}\p{S} ]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.8 AS printable FROM (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents)")
def all_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.coalesce(T.is_all_caps(text), F.lit(False)).alias("caps"), (T.printable_share(text) > 0.8).alias("printable"))


@query("STR-69", r"""WITH t AS (SELECT doc_id, ['Whereas ', 'Here x means ', 'He shall ', '1. ', ''][doc_id % 5 + 1] || text AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?im)^(?:whereas\b|to\s*:|from\s*:|subject\s*:|f\.?no\.?\s*:|ref\.?\s*:|sir\s*,|dear\b)') THEN 'preamble' WHEN regexp_matches(t, '(?i)\b(?:means|includes|shall mean|defined as|refers to|is defined)\b') THEN 'definition'
WHEN regexp_matches(t, '(?i)\b(?:shall|must|hereby|pursuant|notwithstanding|in accordance|herein|therein|thereof)\b') OR regexp_matches(t, '^\s*\d{1,2}[.)]\s') THEN 'provision' ELSE 'concept' END AS kind FROM t""")
def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.element_at(F.array(*[F.lit(s) for s in ("Whereas ", "Here x means ", "He shall ", "1. ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", L.paragraph_kind(F.concat(starts, "text")).alias("kind"))


@query("STR-70 AGG-15", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '"([^"]+)"', 1), regexp_extract_all(t, '[^\n]([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1))))[1:10], '|') AS terms FROM (SELECT doc_id, 'x "alpha ' || doc_id || '" and Loan Amount due' AS t FROM documents)""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('x "alpha '), doc_key(), F.lit('" and Loan Amount due'))
    return docs(spark, sf_dir).select("doc_id", F.array_join(L.key_terms(text), "|").alias("terms"))


def paragraphed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines and numbered items."""
    return docs(spark, sf_dir).withColumn("text", F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n\n2. "))))


@query("CHK-01 CHK-02 CHK-03 CHK-05 FLT-15")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal paragraphs of every document."""
    return C.legal_chunks(paragraphed(spark, sf_dir))


@query("CHK-08 CHK-10", "SELECT doc_id, sha256(text) AS whole, true AS fits FROM documents WHERE text <> ''")
def lossless_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces for a translator, put together again in order."""
    parts = C.exploded(docs(spark, sf_dir), C.pieces)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk"))), lambda r: r["chunk"]), "")
    return parts.groupBy("doc_id").agg(F.sha2(joined, 256).alias("whole"), (F.max(F.length("chunk")) <= C.MOST_PIECE).alias("fits"))


@query("CHK-05", "WITH w AS (SELECT doc_id, unnest(range(1, greatest(length(text) - 50, 1) + 1, 462)) AS s, text FROM documents) SELECT doc_id, s::INT AS start, substr(text, s, 512) AS chunk FROM w")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(C.sliding(F.col("text"), 512, 50)).alias("n", "chunk"))
    return rows.select("doc_id", (F.col("n") * 462 + 1).alias("start"), "chunk")


@query("CHK-06 CHK-07")
def region_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's messages as regions, packed within 1800 characters."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))

    @F.pandas_udf("array<array<int>>")
    def batches(texts: pd.Series, roles: pd.Series) -> pd.Series:
        return pd.Series([C.packed(list(t), ["heading" if r == "system" else "body" for r in rs], C.MOST_PIECE) for t, rs in zip(texts, roles)])

    packed = rows.select("conv_id", F.posexplode(batches(F.col("rows.text"), F.col("rows.role"))).alias("batch", "members"))
    return packed.select("conv_id", "batch", F.size("members").alias("n"), F.array_join("members", ",").alias("members"))


@query("FLT-13", r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'There is no  readable text in ' || text WHEN 1 THEN ' [ Stamp: ' || text || ']' WHEN 2 THEN 'It APPEARS to be ' || text WHEN 3 THEN '[Stamped] ' || text ELSE text END AS t FROM documents)
SELECT doc_id, t FROM t WHERE NOT regexp_matches(t, '(?i)^\s*(?:there\s+is\s+no\s+(readable\s+)?(text|writing)\b|this\s+image\s+(contains|shows|depicts|appears)|the\s+image\s+(contains|shows|depicts|appears)|(it|this)\s+appears\s+to\s+be\b|in\s+(this|the)\s+image\b|no\s+readable\s+(text|content)\b)')
AND NOT regexp_matches(t, '(?i)^\s*\[\s*(?:stamp|seal|image|logo|handwritten|figure|photo|picture|graphic|sign|emblem|signature)\b')""")
def image_remarks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without those that a text recognition says of images."""
    starts = F.element_at(F.array(*[F.lit(s) for s in ("There is no  readable text in ", " [ Stamp: ", "It APPEARS to be ", "[Stamped] ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    block = F.concat(starts, "text", F.when(F.col("doc_id") % 5 == 1, "]").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", block.alias("t")).where(~T.is_image_remark(F.col("t")))


@query("STR-05", r"""WITH t AS (SELECT doc_id, text || '. In State of Kerala v. Thomas Mathew (1976) under Article 14, section ' || doc_id || 'A(b) and Sec. 7' AS t FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(t, '(?i)(?:Article|Art\.|Section|Sec\.)\s+(\d+[A-Z]?(?:\([a-z]\))?)', 1), '|') AS statutes, array_to_string(list_transform(regexp_extract_all(t, '(?i)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+v\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*(?:\((\d{4})\))?'), lambda x: trim(x)), '|') AS cases FROM t""")
def statute_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit(". In State of Kerala v. Thomas Mathew (1976) under Article 14, section "), doc_key(), F.lit("A(b) and Sec. 7"))
    return rows.select("doc_id", F.array_join(L.statutes(F.col("text")), "|").alias("statutes"), F.array_join(L.case_names(F.col("text")), "|").alias("cases"))
