"""Queries whose result depends on an order: jobs, sessions, histories, cause lists, contexts, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.operators import layout as Y
from docketeer.operators import ordered as O
from docketeer.operators import retrieval as R
from docketeer.operators import scans as P
from docketeer.plans.registry import query
from docketeer.sources.tables import table

STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
JOBS = f"""e AS (SELECT user_id AS job_id, ts, event_id, {STATUS} AS status FROM events),
j AS (SELECT job_id, min(ts) AS created_at, arg_max(status, (ts, event_id)) AS s, max(ts) AS last_ts, count(*) AS n_events FROM e GROUP BY job_id),
jobs AS (SELECT job_id, created_at, CASE WHEN s = 'processing' AND epoch((SELECT max(ts) FROM e))::BIGINT - epoch(created_at)::BIGINT > 1800 THEN 'failed' ELSE s END AS status, last_ts, n_events FROM j)"""


def changes_of(events: DataFrame) -> DataFrame:
    """Events as the changes of jobs."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("processing")
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(table(spark, sf_dir, "events"))


@query("STM-01", f"WITH {JOBS} SELECT job_id, created_at, status, CASE WHEN status IN ('completed', 'failed') THEN last_ts END AS completed_at, n_events FROM jobs")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.job_states(job_events(spark, sf_dir))


@query("SORT-10 FLT-09", f"WITH {JOBS} SELECT job_id, created_at, status, (SELECT count(*) FROM jobs WHERE status <> 'pending') AS total FROM jobs WHERE status <> 'pending' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 10")
def job_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = O.job_states(job_events(spark, sf_dir)).where("status <> 'pending'").select("job_id", "created_at", "status")
    return O.page_of(jobs, 10, 20)


@query("WIN-14 STM-02", f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY status IN ('completed', 'failed') ORDER BY last_ts DESC, job_id) AS rn FROM jobs)
SELECT job_id, status FROM r WHERE status NOT IN ('completed', 'failed') OR rn <= 200""")
def job_eviction_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.evicted(O.job_states(job_events(spark, sf_dir))).select("job_id", "status")


@query("SRC-27 STM-08", "SELECT conv_id, min(turn) AS first_turn, left(arg_min(text, turn), 80) AS title, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_first_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.left(F.min_by("text", "turn"), F.lit(80)).alias("title"), F.count("*").alias("n"))


@query("STM-07 JOIN-18 ARR-08", """WITH m AS (SELECT conv_id AS thread, turn AS seq, CASE WHEN turn % 4 = 3 THEN 'tool' ELSE role END AS role, text FROM conversations),
n AS (SELECT *, sum((role <> 'tool')::INT) OVER (PARTITION BY thread ORDER BY seq)::BIGINT AS turn FROM m WHERE role <> 'system')
SELECT thread, turn, max(role) FILTER (role <> 'tool') AS role, max(text) FILTER (role <> 'tool') AS text, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (role = 'tool'), '') AS results, count(*) AS n FROM n WHERE turn > 0 GROUP BY thread, turn""")
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth message stands for a tool's result."""
    role = F.when(F.col("turn") % 4 == 3, "tool").otherwise(F.col("role"))
    return O.history(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), role.alias("role"), "text"))


@query("WIN-07", """SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM conversations""")
def context_window_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return O.around(rows, "conv_id", "turn", "text").drop("text")


@query("AGG-18", """WITH u AS (SELECT doc_id, source, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents)
SELECT source, doc_id, length(CASE WHEN length(text) <= 80000 - used THEN text ELSE left(text, (80000 - used)::BIGINT) END)::BIGINT AS n FROM u WHERE length(text) <= 80000 - used OR 80000 - used > 200""")
def budgeted_concat_80k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's documents give to a context of 80,000 characters."""
    taken = P.budgeted(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", ["doc_id"], "text")
    return taken.select("source", "doc_id", F.length("taken").cast("long").alias("n"))


@query("WIN-08", """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS label FROM pages),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY label) AS first_at FROM p) SELECT page_id, label, turn FROM t ORDER BY turn, first_at LIMIT 60""")
def domain_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty of a search's hits, one of each host in turn."""
    hits = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("label"))
    return R.round_robin(hits, "label", "page_id", 60).select("page_id", "label", "turn")


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query("WIN-06", f"WITH {LINES}, p AS (SELECT *, lag(lower(trim(line))) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM l) SELECT doc_id, count(*) AS kept FROM p WHERE length(line) <= 4 OR prev IS NULL OR prev <> lower(trim(line)) GROUP BY doc_id")
def adjacent_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.without_adjacent_repeats(lines(spark, sf_dir), "doc_id", "n", "line").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("WIN-10 STM-09", f"WITH {LINES}, t AS (SELECT doc_id, n, unnest(string_split(line, ' ')) AS term, unnest(range(len(string_split(line, ' ')))) AS place FROM l) SELECT doc_id, n, place, term, row_number() OVER (PARTITION BY doc_id, term ORDER BY n, place) = 1 AS first FROM t")
def first_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every line."""
    rows = lines(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n"), F.posexplode(F.split("line", " ")).alias("place", "term"))
    return O.first_mentions(rows.withColumn("place", F.col("place").cast("long")), "doc_id", "term", ["n", "place"])


CAUSE = "c AS (SELECT user_id AS page, event_id AS row_no, event_type, CASE WHEN event_type = 'error' THEN 'J' || (event_id % 7) END AS judge, CASE WHEN event_type = 'signup' THEN 'H' || (event_id % 3) END AS hall FROM events)"


def cause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the rows of cause lists: headers, entries, and what follows a "versus"."""
    kind, number = F.col("event_type"), F.col("event_id")
    judge = F.when(kind == "error", F.concat(F.lit("J"), (number % 7).cast("string")))
    hall = F.when(kind == "signup", F.concat(F.lit("H"), (number % 3).cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), number.alias("row_no"), "event_type", judge.alias("judge"), hall.alias("hall"))


@query("WIN-03 STM-05 STR-43", f"WITH {CAUSE} SELECT page, row_no, event_type, last_value(judge IGNORE NULLS) OVER w AS judge, last_value(hall IGNORE NULLS) OVER w AS hall FROM c WINDOW w AS (PARTITION BY page ORDER BY row_no ROWS UNBOUNDED PRECEDING)")
def causelist_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forward_filled(cause_rows(spark, sf_dir), "page", ["row_no"], ["judge", "hall"])


@query("WIN-04", f"""WITH {CAUSE}, g AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY page ORDER BY row_no)::BIGINT AS entry FROM c)
SELECT page, entry, min(row_no) FILTER (event_type = 'click') AS petitioner_row, min(row_no) FILTER (event_type = 'view') AS respondent_row FROM g WHERE entry > 0 GROUP BY page, entry""")
def causelist_vs_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paired(cause_rows(spark, sf_dir), "page", "row_no", F.col("event_type") == "click", F.col("event_type") == "view")


@query("WIN-11", """WITH k AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, role AS kind, sum((prev IS DISTINCT FROM role)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM k""")
def list_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.islands(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role")).drop("role")


@query("WIN-12", "SELECT event_id, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS in_header FROM events")
def header_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").alias("anchor"))
    return Y.header_zone(rows, "user_id", "event_id", "anchor").select("event_id", "in_header")


@query("WIN-13", "SELECT l_orderkey, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS next_part FROM lineitem")
def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Y.with_next(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey", "next_part").drop("l_partkey")


@query("DATE-02 STR-42", """WITH o AS (SELECT o_custkey, list(o_orderdate::DATE ORDER BY o_orderkey) AS d FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1) SELECT o_custkey, list_filter(d, lambda x: x > DATE '1996-06-30')[1] AS next_hearing FROM o""")
def next_hearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each list's first date after a day; every fifth entry is no date."""
    text = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("not listed")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("d")))).alias("x"))
    rows = rows.where(F.exists("x", lambda r: r["d"] != "not listed"))
    return rows.select("o_custkey", O.next_hearing(F.col("x.d"), "1996-06-30").alias("next_hearing"))


SPANS = "s AS (SELECT l_orderkey % 50 AS page, l_orderkey, l_linenumber, 8 + l_quantity / 10 AS size, (l_suppkey % 500)::DOUBLE AS x0, (l_suppkey % 500 + l_quantity)::DOUBLE AS x1, l_linenumber * 14.0::DOUBLE AS y0 FROM lineitem)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text spans on fifty pages."""
    x0 = (F.col("l_suppkey") % 500).cast("double")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), "l_orderkey", "l_linenumber", (8 + F.col("l_quantity") / 10).alias("size"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), (F.col("l_linenumber") * 14.0).alias("y0"))


@query("AGG-09 AGG-10", f"WITH {SPANS} SELECT page, round(median(size), 6) AS median_size, round(quantile_cont(x0, 0.05), 6) AS left_margin, round(quantile_cont(x1, 0.95), 6) AS right_margin FROM s GROUP BY page")
def font_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.page_measures(spans(spark, sf_dir))


@query("MATH-08 MATH-09 AGG-12", f"""WITH {SPANS}, m AS (SELECT page, round(median(size), 6) AS median_size, round(quantile_cont(x0, 0.05), 6) AS l, round(quantile_cont(x1, 0.95), 6) AS r FROM s GROUP BY page)
SELECT CASE WHEN size / median_size >= 1.35 THEN 'title' WHEN size / median_size >= 1.08 THEN 'heading' WHEN size / median_size <= 0.85 THEN 'footnote' ELSE 'body' END AS role,
CASE WHEN abs((x0 - l) - (r - x1)) <= 12 AND x0 - l > 12 THEN 'center' WHEN r - x1 <= 12 AND x0 - l > 12 THEN 'right' ELSE 'left' END AS align, count(*) AS n FROM s JOIN m USING (page) GROUP BY ALL""")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return Y.classified(rows, Y.page_measures(rows)).groupBy("role", "align").agg(F.count("*").alias("n"))


@query("JOIN-15", """WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 500 AS page, (l_suppkey % 500)::DOUBLE AS x0, (l_suppkey % 500 + 20)::DOUBLE AS x1, (l_partkey % 700)::DOUBLE AS y0, (l_partkey % 700 + 14)::DOUBLE AS y1 FROM lineitem),
b AS (SELECT * FROM t WHERE l_linenumber = 1) SELECT a.l_orderkey AS order_a, a.l_linenumber AS line_a, b.l_orderkey AS order_b FROM t a JOIN b ON a.page = b.page AND a.l_linenumber > 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap a table's box on their page."""
    x0, y0 = (F.col("l_suppkey") % 500).cast("double"), (F.col("l_partkey") % 700).cast("double")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 500).alias("page"), x0.alias("x0"), (x0 + 20).alias("x1"), y0.alias("y0"), (y0 + 14).alias("y1"))
    met = Y.overlapping(boxes.where("l_linenumber > 1"), boxes.where("l_linenumber = 1").withColumnRenamed("l_orderkey", "order_b").drop("l_linenumber"), "page", 100)
    return met.select(F.col("l_orderkey").alias("order_a"), F.col("l_linenumber").alias("line_a"), "order_b")


@query("MATH-10", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_discount * 20 - 0.5, 0), 1) * 210, 6) AS left_mm, round(least(greatest(l_tax * 20 - 0.1, 0), 1) * 297, 6) AS top_mm FROM lineitem")
def bbox_millimetres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(Y.clamped(F.col("l_discount") * 20 - 0.5) * 210, 6).alias("left_mm"), F.round(Y.clamped(F.col("l_tax") * 20 - 0.1) * 297, 6).alias("top_mm"))


@query("MATH-12 AGG-11", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) > 0.5 AS bold, round(avg(l_quantity), 6) AS avg_size, bool_or(l_linestatus = 'F') AS any_italic FROM lineitem GROUP BY l_orderkey")
def bold_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((share > 0.5).alias("bold"), F.round(F.avg("l_quantity"), 6).alias("avg_size"), F.bool_or(F.col("l_linestatus") == "F").alias("any_italic"))
