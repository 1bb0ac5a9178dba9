"""Queries over events, settings, errors, archives and services; with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import batch
from leafmill.session import table
from leafmill.streaming import breaker

SETTINGS = [
    ("language", "ko"), ("language", "fr"), ("max_workers", "4"), ("max_workers", "0"), ("max_workers", "33"), ("max_tokens", "10000"), ("max_tokens", "1e3"), ("temperature", "2.0"), ("temperature", "2.1"),
    ("temperature", "hot"), ("verbose", "true"), ("verbose", "yes"), ("content_type", "blog"), ("content_type", "poem"), ("other", "anything"),
]
MODELS = ["gpt-4", "claude-3", "claude", "llama", ""]


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("event_type") != "error").alias("ok")).select(
        "key", "event_id", (F.col("micros") / 1e6).alias("seconds"), "ok"
    )


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return breaker.over_table(_events(spark, d), failures=2, successes=2, timeout=86400.0)


def breaker_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events by their outcome, whether they were let through and the state after them."""
    return circuit_breaker(spark, d).groupBy("ok", "admitted", "state").agg(F.count(F.lit(1)).alias("n"))


def circuit_breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files through the stateful operator, run to the end and read back."""
    import uuid

    from leafmill.session import shared_dir

    at = f"{shared_dir(spark)}/breaker-{uuid.uuid4().hex}"
    _events(spark, d).repartition(4).write.parquet(f"{at}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("key long, event_id long, seconds double, ok boolean").parquet(f"{at}/in")
        out = breaker.over_stream(source, failures=2, successes=2, timeout=86400.0)
        out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    got = breaker.windowed_failures(table(spark, d, "events"), "1 day")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def batch_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return batch.fold(e, F.col("event_type") != "error", F.octet_length("props"), ["user_id"])


def format_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", batch.duration_text(F.floor(F.col("value") * 100)).alias("duration"))


def error_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type joined to the error kind that stands for it."""
    kinds = F.when(F.col("event_type") == "error", "NetworkError").when(F.col("event_type") == "view", "ParseError").otherwise("ConcurrentError")
    e = table(spark, d, "events").groupBy(kinds.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(batch.error_dimension(spark)), "kind").select("kind", F.col("code").cast("long").alias("code"), "recoverable", "n")


def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 11).select(F.col("id").alias("attempt"), batch.retry_delay(F.col("id")).alias("delay_ms"))


def macro_decision(spark: SparkSession, d: str) -> DataFrame:
    ranks = list(batch.RANKS)
    grid = [(f"a.{e}", t, r) for e in ("xlsx", "XLSM", "xlsb", "xls", "doc") for t in ranks for r in ranks]
    got = spark.createDataFrame(grid, "name string, threshold string, level string")
    return got.select("name", "threshold", "level", batch.macro_action(batch.has_macros(F.col("name")), F.col("threshold"), F.col("level")).alias("action"))


def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The highest of the risks in a group, here priorities as risks of a customer's orders."""
    risk = F.element_at(F.create_map(*[F.lit(x) for k, v in (("1-URGENT", "Critical"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium"), ("4-NOT SPECIFIED", "None"), ("5-LOW", "Low")) for x in (k, v)]), F.col("o_orderpriority"))
    return batch.highest_risk(table(spark, d, "orders").withColumn("level", risk), ["o_custkey"], "level")


def config_validation(spark: SparkSession, d: str) -> DataFrame:
    got = spark.createDataFrame(SETTINGS, "key string, value string")
    return got.select("key", "value", F.coalesce(batch.setting_ok(F.col("key"), F.col("value")), F.lit(False)).alias("ok"))


def provider_routing(spark: SparkSession, d: str) -> DataFrame:
    got = spark.createDataFrame([(m,) for m in MODELS], "model string")
    return got.select("model", batch.provider_of(F.col("model")).alias("provider"), batch.masked_key(F.concat(F.col("model"), F.lit("-secret-key"))).alias("masked"))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.generate import usage

    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    got = docs.select("lang", F.length("text").cast("long").alias("prompt_tokens"), F.octet_length("text").cast("long").alias("completion_tokens"))
    return usage(got.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")), ["lang"])


def output_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", batch.output_path("/out/", F.col("file_name"), "md").alias("path"), batch.backup_path(F.col("file_name"), F.lit(1700000000)).alias("backup"))


def append_results(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of both kinds of files appended by name."""
    a = table(spark, d, "pdf_documents").select(F.lit("pdf").alias("kind"), F.col("pdf_id").alias("id"), "title", "author")
    b = table(spark, d, "pptx_files").select(F.lit("pptx").alias("kind"), F.col("pptx_id").alias("id"), "title", "author")
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titles"), F.countDistinct("author").alias("authors"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """One archive of each kind for every nation, made by the writers."""
    import pandas as pd

    from leafmill.sources import ooxml

    rows = table(spark, d, "nation").select("n_nationkey", "n_name")

    def make(batches):
        for b in batches:
            out = []
            for k, name in zip(b["n_nationkey"], b["n_name"]):
                out.append((f"n{k}.docx", ooxml.make_word([("heading", 1, name), ("paragraph", None, f"{name} & <{k}>")], title=name, author="leafmill")))
                out.append((f"n{k}.pptx", ooxml.make_slides([[name, str(k)], ["second", f"slide of {name}"]], title=name)))
                out.append((f"n{k}.xlsx", ooxml.make_workbook({"one": [["name", "key"], [name, str(k)]], "two": [["=A1", "true", ""]]})))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(make, "path string, content binary")


def office_documents(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.sources import ooxml

    return ooxml.read_documents(_archives(spark, d)).select("path", F.col("page").cast("long").alias("page"), "text", "title", "author", "error")


def office_cells(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.sources import ooxml

    return ooxml.read_cells(_archives(spark, d).where(F.col("path").endswith("xlsx")))


def office_replace(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.sources import ooxml

    changed = ooxml.replace_in(_archives(spark, d).where(~F.col("path").endswith("xlsx")), [("slide", "page"), ("A", "a")])
    return ooxml.read_documents(changed.select("path", "content")).join(changed.select("path", "hits"), "path").select("path", F.col("page").cast("long").alias("page"), "text", "hits")


QUERIES = {f.__name__: f for f in (
    circuit_breaker, breaker_summary, circuit_breaker_stream, windowed_events, batch_fold, format_duration, error_dimension, retry_schedule, macro_decision, risk_rollup, config_validation,
    provider_routing, token_usage, output_paths, append_results, office_documents, office_cells, office_replace,
)}

_RANK = "CASE {0} WHEN 'None' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 END"
# The breaker event by event: each round of the recursion takes the next event of every key.
_BREAKER = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS seconds, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::DOUBLE AS seconds, NULL::BOOLEAN AS ok, NULL::BOOLEAN AS admitted, 'closed' AS state, 0 AS failed, 0 AS passed, NULL::DOUBLE AS failure FROM e WHERE n = 1
        UNION ALL SELECT key, n, event_id, seconds, ok, admitted, CASE WHEN NOT admitted THEN 'open' WHEN ok AND was = 'half_open' AND had + 1 < 2 THEN 'half_open' WHEN ok THEN 'closed' WHEN was = 'half_open' OR lost + 1 >= 2 THEN 'open' ELSE was END,
            CASE WHEN NOT admitted THEN lost WHEN ok AND was = 'half_open' AND had + 1 < 2 THEN lost WHEN ok OR was = 'half_open' THEN 0 ELSE lost + 1 END,
            CASE WHEN admitted AND ok AND was = 'half_open' AND had + 1 < 2 THEN had + 1 WHEN admitted AND was = 'half_open' THEN 0 ELSE had END, CASE WHEN admitted AND NOT ok THEN seconds ELSE failure END
        FROM (SELECT e.*, b.failure, b.failed AS lost, NOT (b.state = 'open' AND (b.failure IS NULL OR e.seconds - b.failure < 86400)) AS admitted,
                CASE WHEN b.state = 'open' AND e.seconds - b.failure >= 86400 THEN 'half_open' ELSE b.state END AS was, CASE WHEN b.state = 'open' AND e.seconds - b.failure >= 86400 THEN 0 ELSE b.passed END AS had
            FROM b JOIN e ON e.key = b.key AND e.n = b.n + 1))
    SELECT {0} FROM b WHERE n > 0"""
_NAMES = "unnest(['None', 'Low', 'Medium', 'High', 'Critical'])"
SQL = {
    "circuit_breaker": _BREAKER.format("key, event_id, seconds, ok, admitted, state"),
    "circuit_breaker_stream": _BREAKER.format("key, event_id, seconds, ok, admitted, state"),
    "breaker_summary": _BREAKER.format("ok, admitted, state, count(*) AS n") + " GROUP BY ok, admitted, state",
    "windowed_events": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "batch_fold": """SELECT user_id, count(*) AS processed, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
        coalesce(sum(strlen(props)) FILTER (event_type <> 'error'), 0)::BIGINT AS output_bytes FROM events GROUP BY user_id""",
    "format_duration": """SELECT event_id, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) END AS duration
        FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)""",
    "error_dimension": """SELECT kind, code::BIGINT AS code, recoverable, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'NetworkError' WHEN 'view' THEN 'ParseError' ELSE 'ConcurrentError' END AS kind FROM events)
        JOIN (VALUES ('NetworkError', 5002, true), ('ParseError', 4003, false), ('ConcurrentError', 6001, true)) t(kind, code, recoverable) USING (kind) GROUP BY ALL""",
    "retry_schedule": "SELECT range AS attempt, least(100 * 2 ** (range - 1), 1000)::BIGINT AS delay_ms FROM range(1, 11)",
    "macro_decision": f"""SELECT name, threshold, level, CASE WHEN name IN ('a.xlsx', 'a.doc') OR r = 0 THEN 'Preserve' WHEN r = 4 THEN 'Block' WHEN r = 3 AND t <= 3 THEN 'Block' WHEN r = 3 THEN 'Strip'
        WHEN t <= r THEN 'Strip' ELSE 'WarnAndPreserve' END AS action FROM (SELECT *, {_RANK.format('threshold')} AS t, {_RANK.format('level')} AS r FROM (SELECT name, threshold, {_NAMES} AS level
        FROM (SELECT name, {_NAMES} AS threshold FROM (SELECT unnest(['a.xlsx', 'a.XLSM', 'a.xlsb', 'a.xls', 'a.doc']) AS name))))""",
    "risk_rollup": """SELECT o_custkey, ['None', 'Low', 'Medium', 'High', 'Critical'][max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 2 ELSE 1 END)] AS risk
        FROM orders GROUP BY o_custkey""",
    "config_validation": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', '{v}', {ok})" for (k, v), ok in zip(SETTINGS, ("true", "false", "true", "false", "false", "true", "false", "true", "false", "false", "true", "false", "true", "false", "true"))
    ) + ") t(key, value, ok)",
    "provider_routing": """SELECT model, CASE WHEN starts_with(model, 'gpt-') THEN 'openai' WHEN starts_with(model, 'claude-') THEN 'claude' ELSE 'openai' END AS provider,
        substring(model || '-secret-key', 1, 8) || '***' AS masked FROM (SELECT unnest(['gpt-4', 'claude-3', 'claude', 'llama', '']) AS model)""",
    "token_usage": """SELECT lang, sum(length(text))::BIGINT AS prompt_tokens, sum(strlen(text))::BIGINT AS completion_tokens, sum(length(text) + strlen(text))::BIGINT AS total_tokens FROM documents
        WHERE text IS NOT NULL GROUP BY lang""",
    "output_paths": r"""SELECT doc_id, '/out/' || regexp_replace(file_name, '\.[^.]*$', '') || '.md' AS path, regexp_replace(file_name, '\.[^./\\]+$', '') || '.backup.1700000000.' || regexp_extract(file_name, '\.([^./\\]+)$', 1) AS backup
        FROM documents""",
    "append_results": """SELECT kind, count(*) AS n, count(title) AS titles, count(DISTINCT author) AS authors FROM (SELECT 'pdf' AS kind, title, author FROM pdf_documents UNION ALL SELECT 'pptx', title, author FROM pptx_files)
        GROUP BY kind""",
    "office_documents": """SELECT 'n' || n_nationkey || '.docx' AS path, 1::BIGINT AS page, n_name || ' ' || n_name || ' & <' || n_nationkey || '>' AS text, n_name AS title, 'leafmill' AS author, NULL AS error FROM nation
        UNION ALL SELECT 'n' || n_nationkey || '.pptx', 1, n_name || ' ' || n_nationkey, n_name, NULL, NULL FROM nation
        UNION ALL SELECT 'n' || n_nationkey || '.pptx', 2, 'second slide of ' || n_name, n_name, NULL, NULL FROM nation
        UNION ALL SELECT 'n' || n_nationkey || '.xlsx', 1, 'name' || chr(9) || 'key' || chr(10) || n_name || chr(9) || n_nationkey, NULL, NULL, NULL FROM nation
        UNION ALL SELECT 'n' || n_nationkey || '.xlsx', 2, '=A1' || chr(9) || 'true', NULL, NULL, NULL FROM nation""",
    "office_replace": """WITH n AS (SELECT n_nationkey AS k, replace(n_name, 'A', 'a') AS name, (length(n_name) - length(replace(n_name, 'A', '')))::BIGINT AS c FROM nation)
        SELECT 'n' || k || '.docx' AS path, 1::BIGINT AS page, name || ' ' || name || ' & <' || k || '>' AS text, 2 * c AS hits FROM n
        UNION ALL SELECT 'n' || k || '.pptx', 1, name || ' ' || k, 2 * c + 1 FROM n UNION ALL SELECT 'n' || k || '.pptx', 2, 'second page of ' || name, 2 * c + 1 FROM n""",
    "office_cells": """SELECT 'n' || n_nationkey || '.xlsx' AS workbook, sheet, row::BIGINT AS row, col::BIGINT AS col, CASE value WHEN '$n' THEN n_name WHEN '$k' THEN n_nationkey::VARCHAR ELSE value END AS value, NULL AS error FROM nation,
        (VALUES ('one', 0, 0, 'name'), ('one', 0, 1, 'key'), ('one', 1, 0, '$n'), ('one', 1, 1, '$k'), ('two', 0, 0, '=A1'), ('two', 0, 1, 'true')) t(sheet, row, col, value)""",
}
