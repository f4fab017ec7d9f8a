"""Drafting and translation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions import dates as A
from docketeer.functions import differences
from docketeer.functions import drafting as D
from docketeer.functions import text as X
from docketeer.functions import translation as T
from docketeer.operators import ingest as I
from docketeer.plans.registry import query
from docketeer.plans.texts import doc_key, docs, planted
from docketeer.sources import references as E
from docketeer.sources.shared import kept, scratch
from docketeer.sources.tables import table


@query("STR-20", r"""WITH t AS (SELECT doc_id, text || ' The  defendant shall receive Rs. ' || doc_id || ' under Section 138 , IPC' AS t FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s+([,;.!?])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body FROM t""")
def spelling_and_currency_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit(" The  Defendent shall recieve rs."), doc_key(), F.lit(" under section 138 , ipc"))
    return rows.select("doc_id", D.standardised(F.col("text")).alias("body"))


@query("STR-21", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=== SENDER / CLIENT DETAILS ===' WHEN 1 THEN '=== PLAINTIFF / PETITIONER DETAILS ===' ELSE '=== FIRST PARTY DETAILS ===' END || chr(10) || lang ||
CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN '=== RECIPIENT DETAILS ===' WHEN 1 THEN '=== DEFENDANT / RESPONDENT DETAILS ===' ELSE '=== SECOND PARTY DETAILS ===' END || chr(10) || source ELSE '' END ||
CASE WHEN text <> '' THEN chr(10) || chr(10) || '=== FACTS ===' || chr(10) || text ELSE '' END || chr(10) || chr(10) || '=== RELIEF SOUGHT ===' || chr(10) || n_chars AS body FROM documents""")
def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the facts of a draft."""
    kind = F.element_at(F.array(F.lit("legal_notice"), F.lit("petition"), F.lit("lease")), (F.col("doc_id") % 3 + 1).cast("int"))
    body = D.sections(kind, F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), facts=F.col("text"), relief_sought=F.col("n_chars").cast("string"))
    return docs(spark, sf_dir, "text", "lang", "source", "n_chars").select("doc_id", body.alias("body"))


@query("STR-53", r"""WITH t AS (SELECT conv_id, turn, trim(' "' || text || '..."', ' ') AS t FROM conversations)
SELECT conv_id, turn, left(regexp_replace(regexp_replace(regexp_replace(t, '^["''“”‘’]+', ''), '["''“”‘’]+$', ''), '\.+$', ''), 80) AS title FROM t""")
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a model's title, in quotation marks and with dots."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", D.session_title(F.concat(F.lit(' "'), "text", F.lit('..."'))).alias("title"))


@query("STR-52", r"""WITH t AS (SELECT doc_id, '# Brief' || chr(10) || text || chr(10) || '## Search Query' || chr(10) || chr(10) || ' **bail ' || source || ' ' || doc_id || '**' || chr(10) || '## Next' || chr(10) || text AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_extract(t, '(?i)##\s*Search Query\s*\n+([^\n#]+)', 1), '^[\s"''`*]+|[\s"''`*]+$', '', 'g') AS q FROM t""")
def search_query_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as briefs with a heading for the query."""
    brief = F.concat(F.lit("# Brief\n"), "text", F.lit("\n## Search Query\n\n **bail "), "source", F.lit(" "), doc_key(), F.lit("**\n## Next\n"), "text")
    return docs(spark, sf_dir, "text", "source").select("doc_id", D.search_query(brief).alias("q"))


@query("STR-40 STR-42", r"""WITH t AS (SELECT o_orderkey, upper(substr(o_orderpriority, 3)) || '/' || o_orderkey AS number, CASE WHEN o_totalprice < 100000 THEN ' ' ELSE 'C' || o_custkey END AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS r, 'Case ' || CASE o_orderstatus WHEN 'F' THEN 'Disposed' WHEN 'P' THEN 'Pending hearing' ELSE o_orderpriority END AS state FROM orders)
SELECT o_orderkey, regexp_extract(number, '^[A-Z_]+') AS case_type, CASE WHEN trim(p) <> '' AND r IS NOT NULL THEN p || ' vs ' || r WHEN trim(p) <> '' THEN p ELSE coalesce(r, number) END AS title,
CASE WHEN contains(lower(state), 'disposed') THEN 'CLOSED' WHEN contains(lower(state), 'pending') THEN 'PENDING' ELSE 'ACTIVE' END AS status FROM t""")
def case_detail_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listed cases: the priority names the type, the customer is the petitioner."""
    key, state, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    number = F.concat(F.upper(F.substring(priority, 3, 100)), F.lit("/"), key.cast("string"))
    petitioner, respondent = F.when(F.col("o_totalprice") < 100_000, " ").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))), F.when(key % 3 > 0, priority)
    status = F.concat(F.lit("Case "), F.when(state == "F", "Disposed").when(state == "P", "Pending hearing").otherwise(priority))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.case_type(number).alias("case_type"), D.case_title(petitioner, respondent, number).alias("title"), D.case_status(status).alias("status"))


@query("STR-41 SRC-24", "SELECT c_custkey, c_mktsegment AS stage, 'x' AS judge FROM customer")
def detail_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.lit("Stage."), F.lit(" Judge: "), F.lit("STAGE .."))
    values = F.array(F.lit("first"), F.lit("x"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", D.label_map(labels, values).alias("m")).select("c_custkey", F.col("m")["stage"].alias("stage"), F.col("m")["judge"].alias("judge"))


@query("STR-62", r"""WITH t AS (SELECT event_id, event_type || ' of ' || user_id || CASE event_id % 5 WHEN 0 THEN ': HTTP 429, Retry-After: ' || (user_id % 60) || 's' WHEN 1 THEN ': RESOURCE_EXHAUSTED, retry in ' || (event_id % 90) || '.5' WHEN 2 THEN ': too many requests ' || props ELSE ': error ' || props END AS e FROM events)
SELECT event_id, regexp_matches(lower(e), '\b429\b|rate.?limit|resource.?exhausted|too many requests|quota') AS limited, TRY_CAST(nullif(regexp_extract(lower(e), '(?:retry(?:ing)?[ _-]?(?:after|in|delay)\D{0,5})(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS wait FROM t""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the messages of services; a number in them may be 429 by chance."""
    kind, user = F.col("event_id") % 5, F.col("user_id")
    detail = F.when(kind == 0, F.concat(F.lit(": HTTP 429, Retry-After: "), (user % 60).cast("string"), F.lit("s")))
    detail = detail.when(kind == 1, F.concat(F.lit(": RESOURCE_EXHAUSTED, retry in "), (F.col("event_id") % 90).cast("string"), F.lit(".5")))
    detail = detail.when(kind == 2, F.concat(F.lit(": too many requests "), "props")).otherwise(F.concat(F.lit(": error "), "props"))
    error = F.concat("event_type", F.lit(" of "), user.cast("string"), detail)
    return table(spark, sf_dir, "events").select("event_id", D.is_rate_limit(error).alias("limited"), D.retry_after(error).alias("wait"))


@query("SRC-14 SRC-17 STR-56", "SELECT page_id, url || ' ü' AS path, regexp_extract(url, '[^/]*$') || '.pdf' AS name FROM pages")
def stored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses as percent-encoded names in local storage, and behind the random identifiers of uploads."""
    uploaded = F.concat(F.regexp_extract("url", "^.*/", 0), F.lit("123e4567-e89b-12d3-a456-426614174000_"), F.regexp_extract("url", "[^/]*$", 0), F.lit(".pdf"))
    encoded = F.concat(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("%20%C3%BC"))
    return table(spark, sf_dir, "pages").select("page_id", D.stored_path(F.concat(F.lit("local://"), encoded)).alias("path"), D.original_name(uploaded).alias("name"))


@query("STR-57", "SELECT n_nationkey, '| k | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || '/ |' || chr(10) || '| x |  |' AS md FROM nation")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda *cells: F.array(*cells)
    grid = F.array(row(F.lit("k"), F.lit("name")), row(F.col("n_nationkey").cast("string"), F.concat(F.col("n_name"), F.lit("|"))), row(F.lit(" x ")))
    return table(spark, sf_dir, "nation").select("n_nationkey", D.markdown_table(grid).alias("md"))


@query("STR-61", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' ELSE 'unknown' END AS provider FROM part")
def provider_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(F.lit("claude-x"), F.lit("gpt-4o"), F.lit("gemini-pro"), F.lit("m")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.provider(model).alias("provider"))


@query("STR-13", "SELECT conv_id, turn, '(site:livelaw.in OR site:scconline.com OR site:barandbench.com) ' || text AS q FROM conversations")
def site_scoped_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = F.array_join(F.array(*[F.lit(f"site:{d}") for d in X.DOMAIN_LABELS]), " OR ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("("), sites, F.lit(") "), "text").alias("q"))


@query("STR-44", r"""WITH t AS (SELECT doc_id, text || ' https://x.org/a@b see a.b@c.org S.482 and 2024 2024 ' || (10000 + doc_id) AS t FROM documents),
a AS (SELECT *, regexp_replace(t, 'https?://\S+', '__KEEP__', 'g') AS m FROM t), b AS (SELECT * REPLACE (regexp_replace(m, '[\pL\pN_.+-]+@[\pL\pN_.-]+\.[\pL\pN_]+', '__KEEP__', 'g') AS m) FROM a),
c AS (SELECT * REPLACE (regexp_replace(m, '\b[A-Z][A-Za-z]{0,7}[./][A-Z0-9./]{1,15}\b', '__KEEP__', 'g') AS m) FROM b) SELECT doc_id, regexp_replace(m, '\b\d{4,}\b', '__KEEP__', 'g') AS masked, t AS restored, true AS clean FROM c""")
def english_token_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked, the marks without their numbers, and restored again."""
    rows = planted(spark, sf_dir, F.lit(" https://x.org/a@b see a.b@c.org S.482 and 2024 2024 "), (F.col("doc_id") + 10000).cast("string"))
    rows = rows.select("doc_id", T.mask_english(F.col("text")).alias("m"))
    rows = rows.select("doc_id", F.regexp_replace("m.text", r"__KEEP_\d+__", "__KEEP__").alias("masked"), T.restore_english(F.col("m.text"), F.col("m.kept")).alias("restored"))
    return rows.withColumn("clean", ~T.leftover_marks(F.col("restored")))


@query("STR-24", "SELECT doc_id, nfc_normalize(text || 'e' || chr(769) || 'क' || chr(2364)) AS text FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, F.lit("éक़")).select("doc_id", T.nfc(F.col("text")).alias("text"))


@query("STR-34 STR-36", r"""SELECT doc_id, regexp_replace(text, '\s+([,.])(\s|$)', '\1\2', 'g') || ' धारा ' || doc_id || '। अगला, 1' AS t FROM documents""")
def danda_and_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit(" धारा "), doc_key(), F.lit(" ।अगला , १"))
    return rows.select("doc_id", T.western_digits(T.spaced(F.col("text"))).alias("t"))


@query("STR-30 STR-47 STR-39", "SELECT doc_id, text || ' की abc कि' || doc_id AS t FROM documents")
def script_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir, F.lit(" \ue001क ीabcक ि"), doc_key())
    return rows.select("doc_id", T.script_spaces(T.rejoined_words(T.without_private_glyphs(F.col("text")))).alias("t"))


@query("STR-31 STR-32 AGG-14")
def repeat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with a repeat planted in them."""
    rows = planted(spark, sf_dir, F.lit(" of the court of the court in "), doc_key(), F.lit(" cases in "), doc_key(), F.lit(" cases"))
    return rows.select("doc_id", T.without_repeats(F.col("text")).alias("t"))


@query("STR-29")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with wrapped lines planted in them."""
    rows = planted(spark, sf_dir, F.lit("\nThe order was\npassed "), doc_key(), F.lit(" days\nago.\nNext"))
    return rows.select("doc_id", T.rejoined_lines(F.col("text")).alias("t"))


@query("STR-50")
def inline_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with a few inline tags left, and markup planted behind them."""
    raw = F.concat("html", F.lit("<strong>x</strong><script>bad()</script> <foo>&amp; </foo>"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.sanitised(raw).alias("t"))


@query("STR-65")
def html_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page, in order."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_blocks(F.col("html"))).alias("n", "b"))
    return rows.select("page_id", "n", "b.kind", "b.text")


@query("ARR-06", """WITH t AS (SELECT doc_id, length(text) AS n, length('§new' || doc_id || '§ ') AS a, length('§last' || doc_id || '§') + 1 AS b FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN '0-' || (a + b) ELSE '0-' || a || '|' || (a + n) || '-' || (a + n + b) END AS spans FROM t""")
def reviewer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer added before and behind each document."""
    after = F.concat(F.lit("§new"), doc_key(), F.lit("§ "), "text", F.lit("\n§last"), doc_key(), F.lit("§"))
    places = F.transform(differences.changed_places(F.col("text"), after), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(places, "|").alias("spans"))


@query("SRC-19", "SELECT c_custkey, c_name AS plain FROM customer")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's text under a key of its own, which a master key wraps; decrypted by both."""
    master = F.lit("0123456789abcdef0123456789abcdef")
    key = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 32)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.aes_encrypt(key, master, F.lit("GCM"))).alias("wrapped"), F.aes_encrypt(F.col("c_name"), key, F.lit("GCM")).alias("body"))
    unwrapped = F.aes_decrypt(F.unbase64("wrapped"), master, F.lit("GCM"))
    return rows.select("c_custkey", F.aes_decrypt(F.col("body"), unwrapped, F.lit("GCM")).cast("string").alias("plain"))


@query("ARR-07", """WITH t AS (SELECT doc_id, '[__0001__] ' || text AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) >= 15 THEN left(t, 11) || 'A' || substr(t, 15, 1) || '|' || doc_id || '|' || substr(t, 16) WHEN length(t) = 14 THEN left(t, 11) || 'A' ELSE t END AS t FROM t""")
def style_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smoother's edits on every document: some overlap a sentinel or an earlier edit, lie outside, or are malformed."""
    edits = F.concat(
        F.lit('[{"span":[15,15],"replacement":"|'), doc_key(), F.lit('|"},{"span":[11,14],"replacement":"A"},{"span":[12,16],"replacement":"late"},{"span":[2,4],"replacement":"mark"},'),
        F.lit('{"span":[5],"replacement":"x"},{"span":[-3,1],"replacement":"x"},{"span":[30,20],"replacement":"x"},{"span":[16,17]},{"span":[2000000000,2000000001],"replacement":"x"}]'),
    )
    rows = docs(spark, sf_dir).withColumn("text", F.concat(F.lit("[__0001__] "), "text"))
    return rows.select("doc_id", T.with_edits(F.col("text"), edits).alias("t"))


@query("STR-35", """SELECT doc_id, text || ' “धारा” and "abc" क“x”ख, "a धा' || doc_id AS t FROM documents""")
def devanagari_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation marks that stand by Devanagari on both sides."""
    rows = planted(spark, sf_dir, F.lit(' "धारा" and "abc" क"x"ख, "a धा'), doc_key())
    return rows.select("doc_id", T.devanagari_quotes(F.col("text")).alias("t"))


@query("STR-37", r"""WITH t AS (SELECT doc_id, text || ' U.S. law, the U.K and E.U. but U.SA; DIN-1 F. NO. 2 F.No:3 प्लॉट नं. 4 बैंक  खाता नं 5 मकाननं.' || doc_id AS t FROM documents), c AS (SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(t, '\bU\.S\b\.?', 'अमेरिकी', 'g'), '\bU\.K\b\.?', 'ब्रिटेन', 'g'), '\bE\.U\b\.?', 'यूरोपीय संघ', 'g') AS t FROM t JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\bDIN-', 'डीआईएन-', 'g'), '\bF\.\s*NO\.?[-:\s]', 'फा.सं.-', 'g'), '\bF\.\s*No\.?[-:\s]', 'फा.सं.-', 'g'),
'प्लॉट\s*नं\.?', 'प्लॉट संख्या', 'g'), 'बैंक\s*खाता\s*नं\.?', 'बैंक खाता संख्या', 'g'), 'मकान\s*नं\.?', 'मकान संख्या', 'g') ELSE t END AS t FROM c""")
def country_and_office_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries in Hindi everywhere, labels of offices only in government documents (here the English ones)."""
    planted_text = F.concat("text", F.lit(" U.S. law, the U.K and E.U. but U.SA; DIN-1 F. NO. 2 F.No:3 प्लॉट नं. 4 बैंक  खाता नं 5 मकाननं."), doc_key())
    rows = docs(spark, sf_dir, "text", "lang").select("doc_id", "lang", T.country_names(planted_text).alias("t"))
    return rows.select("doc_id", F.when(F.col("lang") == "en", T.office_labels(F.col("t"))).otherwise(F.col("t")).alias("t"))


@query("STR-23", """WITH t AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND body <> '' THEN text ELSE CASE WHEN doc_id % 2 = 0 THEN '# ' || lang || chr(10) || chr(10) ELSE '' END || '## Source' || chr(10) || source || CASE WHEN body <> '' THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Facts' || chr(10) || body ELSE '' END END AS draft FROM t""")
def assembled_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is a draft; the others are blank ones with sections out of order."""
    part = lambda order, title, content: F.struct(F.lit(order).alias("order"), F.lit(title).alias("title"), content.alias("content"))
    parts = F.array(part(2, "Facts", F.col("text")), part(3, "Empty", F.lit(" \n")), part(1, "Source", F.col("source")))
    draft = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" \n ")
    title = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ")
    return docs(spark, sf_dir, "text", "source", "lang").select("doc_id", D.assembled(draft, title, parts).alias("draft"))


@query("STR-66", """SELECT doc_id, '# DRAFT' || chr(10) || chr(10) || text || chr(10) || chr(10) || '# VERIFICATION REPORT' || chr(10) || chr(10) || '## Claim 1 — ' || CASE WHEN doc_id % 2 = 0 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END || chr(10) || '- Type: statute' || chr(10) || '- Claim text: ' || source || chr(10)
|| CASE WHEN doc_id % 2 = 0 THEN '- Supporting URL: doc/' || doc_id || chr(10) || CASE WHEN text <> '' THEN '- Supporting snippet: ' || left(text, 500) || chr(10) ELSE '' END ELSE '' END || chr(10) || '## Claim 2 — NOT SUPPORTED' || chr(10) || '- Type: quote' || chr(10) || '- Claim text: ' || lang || chr(10) AS report FROM documents""")
def verification_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a draft with two claims; its own text supports the first of every other."""
    even = F.col("doc_id") % 2 == 0
    claim = lambda supported, kind, text, url, snippet: F.struct(supported.alias("supported"), F.lit(kind).alias("type"), text.alias("text"), url.alias("url"), snippet.alias("snippet"))
    none = F.lit(None).cast("string")
    claims = F.array(claim(even, "statute", F.col("source"), F.when(even, F.concat(F.lit("doc/"), doc_key())), F.when(even, F.col("text"))), claim(F.lit(False), "quote", F.col("lang"), none, none))
    return docs(spark, sf_dir, "text", "source", "lang").select("doc_id", D.rewrite_input(F.col("text"), claims).alias("report"))


@query("SRC-29", """SELECT n.n_nationkey AS id, r_name AS category, n_name AS sub_type, CASE WHEN n_nationkey % 4 <> 0 THEN '# ' || n_name || chr(10) || chr(10) || 'Template of ' || r_name || chr(10) END AS body FROM nation n JOIN region ON n_regionkey = r_regionkey""")
def draft_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates as files by category and kind, looked up for every request; some kinds have none."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # as few as there are regions
    asked = nations.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("category"), F.col("n_name").alias("sub_type"))
    body = F.concat(F.lit("# "), "sub_type", F.lit("\n\nTemplate of "), "category")
    with scratch(spark) as folder:
        asked.where("id % 4 <> 0").select(body.alias("value"), "category", "sub_type").write.partitionBy("category", "sub_type").text(folder)
        return kept(E.with_template(asked, E.templates(spark, folder)).select("id", "category", "sub_type", "body"))


@query("SRC-29", "SELECT n_name AS term, 'अनुवाद ' || n_nationkey AS translation FROM nation")
def baseline_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary written as a file of terms, with comments, blank lines and terms without a translation."""
    line = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.col("n_name")), F.lit(":  अनुवाद "), F.col("n_nationkey").cast("string"), F.lit(" "))
    rows = table(spark, sf_dir, "nation").select(F.explode(F.array(line, F.lit("# a comment: none"), F.lit(" "), F.lit("no translation:"))).alias("value"))
    with scratch(spark) as path:
        rows.write.text(path)
        return kept(E.glossary(spark, path))


@query("SRC-29", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 2 THEN 'Notice base' WHEN c_custkey % 5 = 2 THEN CASE WHEN c_custkey % 3 = 1 THEN 'Plaint hindi' ELSE 'Plaint' END END AS structure,
CASE WHEN c_custkey % 5 < 2 THEN CASE WHEN c_custkey % 3 = 1 THEN 'नमूना' ELSE 'sample' END WHEN c_custkey % 5 = 2 THEN 'plaint sample' END AS example FROM customer""")
def draft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples for drafts of several kinds, subtypes and languages, one for each customer."""
    known = [
        ("legal_notice", None, None, "Notice base", "sample"), ("legal_notice", None, "hindi", None, "नमूना"), ("petition", None, None, "Petition", "petition sample"),
        ("petition", "plaint", None, "Plaint", "plaint sample"), ("petition", "plaint", "hindi", "Plaint hindi", None),
    ]
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("legal_notice", "demand_notice", "petition", "lease", "contract")]), (key % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(key.alias("id"), kind.alias("kind"), F.when(key % 5 == 2, "plaint").alias("subtype"), F.when(key % 3 == 1, "hindi").otherwise("english").alias("language"))
    with scratch(spark) as path:
        spark.createDataFrame(known, "kind string, subtype string, language string, structure string, example string").write.json(path)
        return kept(E.with_examples(asked, E.examples(spark, path)).select("id", "structure", "example"))


@query("DATE-03 DATE-04 DATE-07", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2020-02-02' ELSE strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') END AS court_day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, CASE WHEN event_id % 2 = 0 THEN '1999' ELSE strftime(ts, '%Y') END AS case_year FROM events""")
def date_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's moment as the present one."""
    given = F.when(F.col("event_id") % 3 == 0, "2020-02-02").otherwise("")
    year = F.when(F.col("event_id") % 2 == 0, "1999").otherwise(" ")
    return table(spark, sf_dir, "events").select("event_id", A.court_day(F.col("ts"), given).alias("court_day"), A.utc_stamp(F.col("ts")).alias("stamp"), A.case_year(year, F.col("ts")).alias("case_year"))


@query("DATE-05", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'T' || c_custkey ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN '2024-05-01 12:00:00' ELSE '2020-01-01 00:00:00' END AS updated_at FROM customer")
def stamped_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update that stamps the rows it changes with its moment."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("2020-01-01 00:00:00").alias("updated_at"))
    new = old.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("c_name"), F.lit("2024-05-01 12:00:00").alias("updated_at"))
    return I.updated(old, new, "c_custkey", ["c_name", "updated_at"])
