"""Streaming queries, run over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.operators.ordered import evicted
from docketeer.plans.ordered import STATUS, changes_of
from docketeer.plans.registry import query
from docketeer.sources.tables import table
from docketeer.streaming import jobs as J
from docketeer.streaming import runs as S
from docketeer.streaming import sessions as E


@query("STM-01", f"SELECT user_id AS job_id, arg_max({STATUS}, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_the_end(S.job_states(changes_of(S.stream_table(spark, sf_dir, "events"))))


@query("STM-10 SRC-09", "SELECT count(*) AS total, count_if(quality = 1)::BIGINT AS positive FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.lang = 'en'")
def stream_feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of labels joined with the (static) documents."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    rows = S.stream_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")
    return S.to_the_end(S.feedback_stats(rows))


@query("STM-12", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows over the event stream (an extra)."""
    return S.to_the_end(S.windowed(S.stream_table(spark, sf_dir, "events"), "1 day", "30 days"))


@query("STM-06", "SELECT conv_id, turn FROM conversations")
def stream_idempotent_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message arrives twice and is kept once."""
    rows = S.stream_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("2024-01-01").cast("timestamp").alias("at"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.to_the_end(S.first_of_each(twice, ["conv_id", "turn"], "at", "1 hour"), "append").select("conv_id", "turn")


def day_jobs(changes: DataFrame) -> DataFrame:
    """The changes of jobs that live for a day: each user's events of a day are a job's."""
    return changes.withColumn("job_id", F.col("job_id") * 400 + F.dayofyear("ts"))


JOB_CHANGES = f"""WITH e AS (SELECT user_id * 400 + dayofyear(ts) AS job_id, epoch_us(ts) // 1000 AS t, {{'a': epoch_us(ts) // 1000, 'i': event_id}} AS k, {STATUS} AS status FROM events),
w AS (SELECT max(t) - 86400000 AS now FROM e), due AS (SELECT e.* FROM e, w WHERE t < now),
c AS (SELECT job_id, min(k) AS c FROM due WHERE status = 'pending' GROUP BY job_id),
r AS (SELECT c.job_id, c.c, min(d.k) FILTER (status = 'processing' AND d.k > c.c) AS p, min(d.k) FILTER (status = 'failed' AND d.k > c.c) AS f FROM c JOIN due d ON c.job_id = d.job_id GROUP BY ALL),
x AS (SELECT r.*, f IS NOT NULL AND (p IS NULL OR f < p) AS cancelled, min({{'a': d.k.a, 'i': d.k.i, 's': d.status}}) FILTER (d.k > p AND d.status IN ('completed', 'failed')) AS e FROM r JOIN due d ON r.job_id = d.job_id GROUP BY ALL),
y AS (SELECT *, CASE WHEN cancelled THEN 1 WHEN p IS NULL THEN 2 WHEN e IS NOT NULL AND e.a <= p.a + 1800000 THEN 3 WHEN p.a + 1800000 < now THEN 4 ELSE 5 END AS way FROM x, w)
SELECT job_id, ['failed', 'pending', e.s, 'failed', 'processing'][way] AS status, [f.a, c.a, e.a, p.a + 1800000, p.a][way] AS at_ms,
CASE WHEN way = 4 THEN '[UNKNOWN] Job timed out after 1800s' END AS error, [2, 1, 3, 3, 2][way]::BIGINT AS n_changes FROM y"""


@query("STM-01 STM-02", JOB_CHANGES)
def stream_job_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each day's jobs from their legal changes, timers included, up to a day before the newest event."""
    rows = S.stream_table(spark, sf_dir, "events")
    changes = J.job_changes(day_jobs(changes_of(rows)), "1 day")
    return J.latest(S.finished(changes, J.STORE))


@query("STM-12", """WITH n AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR, true) AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n), w AS (SELECT epoch_us(max(ts)) // 1000 - 7200000 AS w FROM events)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s HAVING epoch_us(max(ts) + INTERVAL 1 HOUR) <= (SELECT w FROM w) * 1000""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions with pauses under an hour, as far as they are closed two hours before the newest event (an extra)."""
    return S.finished(E.sessions(S.stream_table(spark, sf_dir, "events"), "user_id", "1 hour", "2 hours"))


@query("STM-12 JOIN-18", """WITH c AS (SELECT user_id, event_id AS call_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS result_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT epoch_us(max(ts)) // 1000 FROM c), (SELECT epoch_us(max(ts)) // 1000 FROM r)) - 86400000 AS w)
SELECT c.user_id, call_id, result_id FROM c LEFT JOIN r ON c.user_id = r.user_id AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 6 HOUR WHERE result_id IS NOT NULL OR epoch_us(c.ts + INTERVAL 6 HOUR) < (SELECT w FROM w) * 1000""")
def stream_answered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls and purchases as their results, within six hours (an extra)."""
    part = lambda kind: S.stream_table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    return S.finished(E.answered(part("click"), part("purchase"), "user_id", "6 hours", "1 day")).select("user_id", "call_id", "result_id")


@query("STM-12", """WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01')]) AS window_start, event_type, value FROM events)
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day every twelve hours over the event stream (an extra)."""
    return S.to_the_end(S.windowed(S.stream_table(spark, sf_dir, "events"), "1 day", "30 days", "12 hours"))


@query("STM-09", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
t AS (SELECT doc_id, n, unnest(string_split(line, ' ')) AS term, unnest(range(len(string_split(line, ' ')))) AS place FROM l) SELECT doc_id, term, min(n * 1000000 + place)::BIGINT AS first_at, count(*) AS n FROM t GROUP BY doc_id, term""")
def stream_first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each word in each document, from a stream of documents."""

    def of_batch(docs: DataFrame) -> DataFrame:
        # dealt before they are words, documents needn't be dealt again
        lines = docs.repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
        words = lines.select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("place", "term"))
        return S.first_mentions(words.select("doc_id", "term", (F.col("n").cast("long") * 1_000_000 + F.col("place")).alias("at")))

    return S.merged(S.stream_table(spark, sf_dir, "documents").select("doc_id", "text"), of_batch, S.first_of_parts)


@query("STM-02", f"""WITH j AS ({JOB_CHANGES}), r AS (SELECT *, row_number() OVER (PARTITION BY status IN ('completed', 'failed') ORDER BY at_ms DESC, job_id) AS rn FROM j)
SELECT job_id, status FROM r WHERE status NOT IN ('completed', 'failed') OR rn <= 200""")
def stream_job_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of the stream that stay: those that run, and the newest two hundred that ended."""
    changes = J.job_changes(day_jobs(changes_of(S.stream_table(spark, sf_dir, "events"))), "1 day")
    jobs = J.latest(S.finished(changes, J.STORE)).withColumnRenamed("at_ms", "completed_at").withColumn("created_at", F.col("completed_at"))
    return evicted(jobs).select("job_id", "status")
