"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.llm import decontam, imatch, language, linededup, negatives, packing, quality, secrets, simhash, spelling, substrings, tokencount, urlfilter
from docketeer.llm.common import crc, documents, spread, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, parent domains and locations of the pages, derived from their MD5.

    The pages have no lists beside them; these give every host a history of additions and removals in 2024.
    """
    name = urlfilter.host(F.col("url"))
    digit = lambda i: (F.instr(F.lit("0123456789abcdef"), F.substring("md5", i, 1)) - 1)
    hosts = pages.select(F.lit("domain").alias("kind"), F.explode(urlfilter.domains(name)).alias("key")).where("instr(key, '.') > 0").distinct()
    urls = pages.select(F.lit("url").alias("kind"), urlfilter.location(F.col("url")).alias("key")).distinct()
    known = hosts.union(urls).withColumn("md5", F.md5("key"))
    known = known.where((digit(1) < 4) | F.col("key").like("example.%")).withColumn("list", F.when(digit(2) < 8, "ads").otherwise("malware"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(digit(3) * 12).alias("at")),
        F.struct(F.when(digit(5) < 12, "remove").alias("action"), day(digit(3) * 12 + 30 + digit(4) * 4).alias("at")),
        F.struct(F.when(digit(6) < 6, "add").alias("action"), day(digit(3) * 12 + 120 + digit(4) * 4).alias("at")),
    )
    return known.select("list", "kind", "key", F.explode(steps).alias("s")).select("list", "kind", "key", "s.action", "s.at")


def op1_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the lists that named its URL or a domain of it on its (derived) day of fetching."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture"), "url", fetched.alias("at"))
    return urlfilter.judge(captures, dated_entries(pages)).withColumnsRenamed({"capture": "page_id", "at": "fetched_on"})


OP1 = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest FROM pages
), asked AS (
  SELECT page_id, fetched_on, 'domain' AS kind, array_to_string(string_split(host, '.')[unnest(range(1, len(string_split(host, '.')) + 1)):], '.') AS key FROM captures
  UNION ALL SELECT page_id, fetched_on, 'url', host || rest FROM captures
), known AS (
  SELECT DISTINCT kind, key, md5(key) AS md5 FROM asked WHERE kind = 'url' OR contains(key, '.')
), digits AS (
  SELECT kind, key, [strpos('0123456789abcdef', md5[i]) - 1 FOR i IN range(1, 7)] AS d FROM known
), listed AS (
  SELECT *, CASE WHEN d[2] < 8 THEN 'ads' ELSE 'malware' END AS list FROM digits WHERE d[1] < 4 OR key LIKE 'example.%'
), entries AS (
  SELECT list, kind, key, 'add' AS action, DATE '2024-01-01' + (d[3] * 12)::INT AS day FROM listed
  UNION ALL SELECT list, kind, key, 'remove', DATE '2024-01-01' + (d[3] * 12 + 30 + d[4] * 4)::INT FROM listed WHERE d[5] < 12
  UNION ALL SELECT list, kind, key, 'add', DATE '2024-01-01' + (d[3] * 12 + 120 + d[4] * 4)::INT FROM listed WHERE d[6] < 6
), latest AS (
  SELECT a.page_id, e.list, e.kind, e.key, arg_max(e.action, e.day) AS action FROM asked a JOIN entries e ON a.kind = e.kind AND a.key = e.key AND e.day <= a.fetched_on GROUP BY ALL
), found AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM latest WHERE action = 'add' GROUP BY page_id
)
SELECT c.page_id, c.url, c.fetched_on, f.page_id IS NOT NULL AS blocked, coalesce(f.lists, '') AS lists, coalesce(f.n, 0)::BIGINT AS n_entries
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id
"""


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines whose template an earlier document has."""
    return linededup.drop_recurring(documents(spark, sf_dir).select("doc_id", "text"))


def op3_longest_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_path("byte_bpe_50k.tiktoken")).drop("text")


def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, with at most eight edits in a hundred characters."""
    return decontam.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out; a row without an id is in no fold, and not learned from."""
    fold = crc(F.col("doc_id")) % 5
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    model = language.learn(docs.where(fold != 0))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(documents(spark, sf_dir))


def op7_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from the labels of the folds that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")).where(crc(F.col("doc_id")) % 5 != 0)
    scored = quality.score(docs, quality.learn(docs, labels, ["lang", "source"]))
    return scored.select("doc_id", (crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("quality_pred"))


def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and weak parts that complete one another."""
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op11_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every fiftieth vector, against all vectors."""
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    strange = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~strange).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


OP11 = r"""
WITH held AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rn, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, b.rn AS other, list_dot_product(a.v, b.v)::BIGINT AS score FROM held a JOIN held b ON a.rn <> b.rn WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT rn, anchor_id, other, vec_id AS positive_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rn, p.other ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.rn = n.rn AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

def op12_difference_cover_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words or more that recur."""
    digest = {"kept_sha256": F.sha2(F.col("kept").cast("binary"), 256)}
    return substrings.without_repeats(documents(spark, sf_dir), returned=digest).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT rn, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM (SELECT rn, words, unnest(range(1, len(words) - 33)) AS i FROM texts)
), starts AS (
  SELECT rn, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), gone AS (
  SELECT DISTINCT rn, unnest(range(i, i + 35)) AS i FROM starts
), single AS (
  SELECT rn, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
), kept AS (
  SELECT s.rn, string_agg(s.word, ' ' ORDER BY s.i) AS kept, count(*) AS n FROM single s ANTI JOIN gone g ON s.rn = g.rn AND s.i = g.i GROUP BY s.rn
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (rn)
"""

def drawn_words(docs: DataFrame) -> DataFrame:
    """``word``: the runs of letters of all documents, of which about one in 199 loses a letter, drawn by a checksum of id and run."""
    words = spelling.occurrences(docs, least_letters=6)  # a shorter run has no six letters left
    drawn = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    words = words.select("word", drawn.alias("h"))
    cut = spelling.without(F.col("word"), (F.col("h") % F.length("word")).cast("int"))
    return words.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("word")).alias("word"))


def op13_rolling_hash_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(drawn_words(documents(spark, sf_dir)))


OP2 = r"""
WITH raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), lines AS (
  SELECT doc_id, line_no, CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '\S*[0-9]\S*', '<*>', 'g')
    ELSE trim(regexp_replace(raw, '\s+', ' ', 'g')) END AS line FROM raw_lines WHERE raw <> ''
), kept AS (
  SELECT *, string_split(line, ' ') AS tokens, len(string_split(line, ' ')) AS n, array_to_string(string_split(line, ' ')[1:5], ' ') AS lead FROM lines WHERE len(string_split(line, ' ')) >= 3
), forms AS (
  SELECT DISTINCT line, tokens, n, lead FROM kept
), fields AS (
  SELECT line, n, lead, unnest(tokens) AS token, unnest(range(n)) AS pos FROM forms
), fixed AS (
  SELECT line, n, lead, token, pos, count(*) OVER (PARTITION BY n, lead, pos, token) > 1 AS is_fixed FROM fields
), shapes AS (
  SELECT line, n, lead, list(CASE WHEN is_fixed THEN token END ORDER BY pos) AS shape, count_if(is_fixed) AS n_fixed FROM fixed GROUP BY ALL
), named AS (
  SELECT f.line, CASE WHEN s.line IS NULL THEN f.line ELSE concat('t', s.n, ' ', s.shape::VARCHAR) END AS form, s.line IS NOT NULL AS general
  FROM forms f LEFT JOIN shapes s ON f.line = s.line AND s.n_fixed >= s.n * 0.8 AND s.n_fixed < s.n
), owners AS (
  SELECT form, general, min(doc_id) AS owner FROM kept JOIN named USING (line) GROUP BY ALL
), dropped AS (
  SELECT k.doc_id, k.line_no FROM kept k JOIN named USING (line) JOIN owners o USING (form, general) WHERE k.doc_id <> o.owner
)
SELECT a.doc_id, coalesce(string_agg(a.raw, chr(10) ORDER BY a.line_no) FILTER (d.line_no IS NULL), '') AS text, count(*)::INT AS n_lines, count(d.line_no)::INT AS n_dropped
FROM raw_lines a LEFT JOIN dropped d ON a.doc_id = d.doc_id AND a.line_no = d.line_no GROUP BY a.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_temporal_url_lists, op2_line_templates, op3_longest_match_tokens, op4_pigeonhole_decontamination, op5_cross_parsing_language, op6_imatch_fingerprints, op7_simhash_bk_trees, op8_co_trained_quality, op9_linked_secrets, op10_best_fit_packing, op11_pivot_hard_negatives, op12_difference_cover_passages, op13_rolling_hash_spellings]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_temporal_url_lists": OP1, "op2_line_templates": OP2, "op11_pivot_hard_negatives": OP11, "op12_difference_cover_passages": OP12}
