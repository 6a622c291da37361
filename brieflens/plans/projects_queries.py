"""Uploads, project lists, runs, histories, answer repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import answers as A
from ..operators import projects as P
from ..sources import tables as T
from . import oracle as O
from .registry import register

NAMES = ["Plan.DOCX", "notes/brief.txt", "a.exe", "..", "deck.pptx", "set.yaml", "noext", "x.json"]


@register("ingest_manifest", f"""
WITH f AS (SELECT o_orderkey, {O.pick('o_orderkey % 8', NAMES)} AS name, (o_totalprice * 1500)::BIGINT AS size, (['source', 'prompt', 'other'])[CASE WHEN o_orderkey % 10 = 9 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END] AS category FROM orders),
b AS (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS file_name FROM f), e AS (SELECT *, lower(regexp_extract(file_name, '[^.]\\.([^.]+)$', 1)) AS ext FROM b),
r AS (SELECT *, CASE WHEN category = 'other' THEN 'bad category' WHEN file_name IN ('', '.', '..') THEN 'bad name' WHEN NOT list_contains(CASE WHEN category = 'source' THEN {O.sql_list(fixed.SOURCE_EXTENSIONS)} ELSE {O.sql_list(fixed.PROMPT_EXTENSIONS)} END, ext) THEN 'bad type'
  WHEN size > {fixed.MAX_FILE_BYTES} THEN 'too large' END AS reason FROM e)
SELECT o_orderkey, name, size, category, file_name, ext, CASE WHEN reason IS NULL THEN 'uploaded' ELSE 'rejected' END AS status, reason FROM r""")
def ingest_manifest(spark, d):
    n = F.col("o_orderkey")
    files = T.load(spark, d, "orders").select(
        "o_orderkey", T.pick(n % 8, NAMES).alias("name"), F.round(F.col("o_totalprice") * 1500).cast("long").alias("size"),
        F.when(n % 10 == 9, "other").when(n % 2 == 0, "source").otherwise("prompt").alias("category"))
    return P.ingest_manifest(files)


@register("project_list", """
SELECT c.c_custkey AS project_id, c.c_name AS name, CASE WHEN c.c_custkey % 3 = 0 THEN 'sow' ELSE 'new' END AS workflow, count(o.o_orderkey) AS file_count, coalesce(sum(o.o_orderkey % 9), 0)::BIGINT AS chunk_count
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 3 > 0 GROUP BY ALL""")
def project_list(spark, d):
    n = F.col("c_custkey")
    projects = T.load(spark, d, "customer").select(n.alias("project_id"), F.col("c_name").alias("name"), F.when(n % 3 == 0, "sow").alias("workflow"))
    files = T.load(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 9).alias("chunk_count"))
    return P.project_list(projects, files, exclude="sow")


@register("run_counts", """
SELECT o_custkey AS project_id, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS failed,
  count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 1) AS running, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending FROM orders GROUP BY o_custkey""")
def run_counts(spark, d):
    s, n = F.col("o_orderstatus"), F.col("o_orderkey")
    status = F.when(s == "F", "done").when((s == "O") & (n % 2 == 0), "failed").when(s == "O", "running").when(n % 2 == 0, "pending")
    return P.run_counts(T.load(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), status.alias("status")))


@register("retain_latest", """
SELECT o_custkey AS session_id, o_orderkey AS result_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders QUALIFY rn <= 5""")
def retain_latest(spark, d):
    results = T.load(spark, d, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("result_id"), F.col("o_orderdate").alias("created_at"))
    return P.retain_latest(results, 5).select("session_id", "result_id", "rn")


def messages(spark, d):
    return T.load(spark, d, "conversations").select(
        (F.col("conv_id") % 5).alias("user"), F.col("conv_id").alias("chat_id"), "turn", "role", "text",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))


HISTORY = f"""history AS (SELECT conv_id % 5 AS user, conv_id AS chat_id, coalesce(arg_min(CASE WHEN length(flat) > 60 THEN left(flat, 60) || '…' ELSE flat END, turn) FILTER (role = 'user' AND flat <> ''), 'New chat') AS title,
  count(*) AS message_count, max(conv_id * 1000 + turn) AS updated_at FROM (SELECT *, {O.collapse('text')} AS flat FROM conversations) GROUP BY conv_id)"""


@register("history_list", f"WITH {HISTORY} SELECT * FROM history")
def history_list(spark, d):
    return P.history_list(messages(spark, d))


@register("history_upsert", f"""
WITH {HISTORY}, old AS (SELECT user, chat_id, 'Old' AS title, 1::BIGINT AS created_at, 2::BIGINT AS updated_at, 1::BIGINT AS message_count FROM history WHERE chat_id % 2 = 0),
new AS (SELECT * FROM history WHERE chat_id % 3 > 0 AND NOT (chat_id % 7 = 1))
SELECT coalesce(o.user, n.user) AS user, coalesce(o.chat_id, n.chat_id) AS chat_id, coalesce(n.title, o.title) AS title, coalesce(o.created_at, n.updated_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at,
  coalesce(n.message_count, o.message_count) AS message_count FROM old o FULL JOIN new n ON o.user = n.user AND o.chat_id = n.chat_id""")
def history_upsert(spark, d):
    rows = P.history_list(messages(spark, d))
    c = F.col("chat_id")
    old = rows.filter(c % 2 == 0).select("user", "chat_id", F.lit("Old").alias("title"), F.lit(1).cast("long").alias("created_at"),
                                         F.lit(2).cast("long").alias("updated_at"), F.lit(1).cast("long").alias("message_count"))
    new = rows.filter(c % 3 > 0).withColumn("message_count", F.when(c % 7 == 1, 0).otherwise(F.col("message_count")))
    return P.history_upsert(old, new)


@register("ttl_answer_dedupe", """
WITH RECURSIVE q AS (SELECT event_id, event_type || user_id % 3 AS key, epoch(ts) AS t0 FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t0, event_id) AS rn FROM q),
walk AS (SELECT key, rn, event_id, t0 AS since, true AS fresh FROM o WHERE rn = 1
  UNION ALL SELECT o.key, o.rn, o.event_id, CASE WHEN o.t0 - w.since > 3600 THEN o.t0 ELSE w.since END, o.t0 - w.since > 3600 FROM walk w JOIN o ON o.key = w.key AND o.rn = w.rn + 1)
SELECT key, event_id AS id, fresh FROM walk""")
def ttl_answer_dedupe(spark, d):
    questions = T.load(spark, d, "events").select(
        F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("key"), F.col("event_id").alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return A.answer_first_seen(questions)
