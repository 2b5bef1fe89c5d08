"""Stored tables, lookups, review, templates, enrichment and messages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fabtrail import schema as S
from fabtrail.catalog.base import LOGS_SQL, logs_from_events as logs, query, table, with_logs
from fabtrail.catalog.formats import INGEST_TS
from fabtrail.functions.masking import MASKS, mask_message
from fabtrail.functions.signatures import file_signature
from fabtrail.operators import aggregates as A, enrich as U, lookups as J, templates as T
from fabtrail.operators.ordering import POSITION, number_rows
from fabtrail.operators.tables import LogStore, to_recipes
from fabtrail.plans import review as V
from fabtrail.session import scratch_path, spread
from fabtrail.sources.render import json_record
from fabtrail.streaming import ingest as M

CORE = ["id", "timestamp", "tool_id", "severity", "log_type", "source_filename"]
CORE_SQL = ", ".join(CORE)


def _store(spark) -> LogStore:
    store = LogStore(spark, scratch_path(spark, "catalog-store"))
    store.create()
    return store


# -- appends, replacement, deletion ---------------------------------------------------------------


@query("append_new_ids", with_logs(f"SELECT {CORE_SQL}, CASE WHEN log_type = 'alarm' THEN 'first' ELSE 'second' END AS raw_message FROM logs"))
def append_new_ids(spark, sf_dir):
    """Alarms are stored first; then all rows come, twice, and only new ids are added."""
    store, rows = _store(spark), logs(spark, sf_dir)
    store.append("logs", rows.where(F.col("log_type") == "alarm").withColumn("raw_message", F.lit("first")))
    again = rows.withColumn("raw_message", F.lit("second"))
    store.append("logs", again.unionByName(again))
    return store.read("logs").select(*CORE, "raw_message")


@query(
    "append_counts",
    with_logs("SELECT 2 * count(*) AS attempted, count(*) FILTER (log_type <> 'alarm') AS inserted FROM logs"),
)
def append_counts(spark, sf_dir):
    store, rows = _store(spark), logs(spark, sf_dir)
    store.append("logs", rows.where(F.col("log_type") == "alarm"))
    done = store.append("logs", rows.unionByName(rows))
    return spark.createDataFrame([(done.attempted, done.inserted)], "attempted bigint, inserted bigint")


@query(
    "append_recipe_rows",
    with_logs("SELECT id, timestamp, tool_id, recipe_id, raw_message, source_filename FROM logs WHERE log_type = 'process_step'"),
)
def append_recipe_rows(spark, sf_dir):
    """Recipe rows among the logs also reach the recipe table."""
    store, rows = _store(spark), logs(spark, sf_dir)
    kind = F.when(F.col("log_type") == "process_step", F.lit("recipe")).otherwise(F.col("log_type"))
    store.append_logs(rows.withColumn("log_type", kind))
    return store.read("recipes").select("id", "timestamp", "tool_id", "recipe_id", "raw_message", "source_filename")


@query("append_first_wins", with_logs("SELECT id, 'copy 1' AS raw_message FROM logs"))
def append_first_wins(spark, sf_dir):
    """Of unequal copies of an id in one batch the first stays."""
    store, rows = _store(spark), logs(spark, sf_dir)
    copies = rows.withColumn("raw_message", F.explode(F.array(*[F.lit(f"copy {k}") for k in (1, 2, 3)])))
    store.append("logs", copies, within_files=True)
    store.append("logs", copies.withColumn("raw_message", F.lit("late")), within_files=True)
    return store.read("logs").select("id", "raw_message")


@query(
    "edit_last_wins",
    with_logs("SELECT id, CASE WHEN source_filename = 'events_20240105.log' THEN 'edit 3' ELSE '{}' END AS record_data FROM logs WHERE severity = 'ERROR'"),
)
def edit_last_wins(spark, sf_dir):
    """Of several edits of a row in one batch the last counts; other jobs are not touched."""
    store = _store(spark)
    rows = logs(spark, sf_dir).where(F.col("severity") == "ERROR")
    pending = rows.select("id", F.col("source_filename").alias("job_id"), F.col("source_filename").alias("filename"), F.lit("{}").alias("record_data"))
    store.stage(pending)
    own = pending.where(F.col("job_id") == "events_20240105.log")
    store.edit(own.select("id", F.explode(F.array(*[F.lit(f"edit {k}") for k in (1, 2, 3)])).alias("record_data")))
    return store.read("pending_reviews").select("id", "record_data")


@query(
    "replace_counts",
    with_logs("SELECT 2 * count(*) AS attempted, count(*) AS inserted FROM logs WHERE source_filename = 'events_20240105.log'"),
)
def replace_counts(spark, sf_dir):
    """Rows that came and rows that were stored are told apart."""
    store, rows = _store(spark), logs(spark, sf_dir)
    store.append("logs", rows)
    done = store.replace_file("events_20240105.log", rows.unionByName(rows))
    return spark.createDataFrame([(done.attempted, done.inserted)], "attempted bigint, inserted bigint")


@query("not_present_ids", with_logs("SELECT id, severity FROM logs WHERE severity <> 'INFO'"))
def not_present_ids(spark, sf_dir):
    rows = logs(spark, sf_dir)
    return J.not_present(rows, rows.where(F.col("severity") == "INFO"), "id").select("id", "severity")


@query("delete_file", with_logs(f"SELECT {CORE_SQL} FROM logs WHERE source_filename <> 'events_20240105.log'"))
def delete_file(spark, sf_dir):
    store = _store(spark)
    store.append("logs", logs(spark, sf_dir))
    store.delete_file("events_20240105.log")
    return store.read("logs").select(*CORE)


@query(
    "replace_file",
    with_logs(
        """SELECT id, tool_id, CASE WHEN source_filename = 'events_20240105.log' THEN 'new' ELSE raw_message END AS raw_message FROM logs
           WHERE source_filename <> 'events_20240105.log' OR severity <> 'INFO'"""
    ),
)
def replace_file(spark, sf_dir):
    store, rows = _store(spark), logs(spark, sf_dir)
    store.append("logs", rows)
    new = rows.where(F.col("severity") != "INFO").withColumn("raw_message", F.lit("new"))
    store.replace_file("events_20240105.log", new)
    return store.read("logs").select("id", "tool_id", "raw_message")


@query("clear_tables", with_logs("SELECT 0::BIGINT AS logs, 0::BIGINT AS recipes, 0::BIGINT AS pending, count(DISTINCT tool_id) AS templates FROM logs"))
def clear_tables(spark, sf_dir):
    """Rows go, saved templates stay."""
    store, rows = _store(spark), logs(spark, sf_dir)
    store.append("logs", rows)
    store.append("recipes", to_recipes(rows.withColumn("log_type", F.lit("recipe"))))
    store.stage(V.to_pending(rows))
    store.save_template(_templates(rows))
    store.clear()
    count = lambda t: store.read(t).agg(F.count(F.lit(1)))
    return count("logs").toDF("logs").withColumns(
        {
            "recipes": count("recipes").scalar(),
            "pending": count("pending_reviews").scalar(),
            "templates": count("format_templates").scalar(),
        }
    )


# -- lookups -----------------------------------------------------------------------------------------


def _templates(rows):
    """Two templates per tool, one saved per severity class; the newest counts."""
    saved = rows.groupBy("tool_id").agg(F.max("timestamp").alias("newest"), F.min("timestamp").alias("oldest"))
    both = saved.select(
        "tool_id", F.explode(F.array("oldest", "newest")).alias("created_at"), "newest"
    )
    return both.select(
        F.concat("tool_id", F.lit("/"), "created_at").alias("id"),
        F.concat(F.lit("template of "), "tool_id", F.lit(" at "), "created_at").alias("name"),
        F.concat(F.lit("bin:"), "tool_id").alias("file_signature"),
        F.create_map(F.lit("x"), F.lit("tool_id")).alias("field_mapping"),
        F.lit("").alias("sample_preview"),
        "created_at",
    )


@query(
    "saved_templates",
    with_logs("SELECT 'bin:' || tool_id AS file_signature, 'template of ' || tool_id || ' at ' || max(timestamp) AS name FROM logs GROUP BY tool_id"),
)
def saved_templates(spark, sf_dir):
    """Saving under a known signature takes the place of the older template."""
    store = _store(spark)
    saved = _templates(logs(spark, sf_dir))
    store.save_template(saved)
    store.save_template(saved)
    return store.templates().select("file_signature", "name")


@query(
    "deleted_templates",
    with_logs("SELECT 'bin:' || tool_id AS file_signature FROM logs GROUP BY tool_id HAVING tool_id <> 'TOOL-0008'"),
)
def deleted_templates(spark, sf_dir):
    store = _store(spark)
    store.save_template(_templates(logs(spark, sf_dir)))
    store.delete_template(store.template("bin:TOOL-0008").first()["id"])
    return store.templates().select("file_signature")


@query(
    "template_of_signature",
    with_logs(
        """SELECT l.id, CASE WHEN log_type = 'alarm' THEN 'template of ' || tool_id || ' at ' || newest END AS template_name
           FROM logs l JOIN (SELECT tool_id, max(timestamp) AS newest FROM logs GROUP BY 1) USING (tool_id)"""
    ),
)
def template_of_signature(spark, sf_dir):
    rows = logs(spark, sf_dir)
    files = rows.select(
        "id", F.concat(F.when(F.col("log_type") == "alarm", F.lit("bin:")).otherwise(F.lit("dat:")), "tool_id").alias("signature")
    )
    return J.match_templates(files, _templates(rows)).select("id", "template_name")


@query(
    "mapping_of_file",
    with_logs("""SELECT source_filename, min(id) AS mapped FROM (
        SELECT source_filename, id, timestamp, min(timestamp) OVER (PARTITION BY source_filename) AS first FROM logs)
        WHERE timestamp = first GROUP BY 1"""),
)
def mapping_of_file(spark, sf_dir):
    rows = logs(spark, sf_dir)
    mappings = rows.select(
        F.col("id").alias("header_fingerprint"), F.create_map(F.lit("id"), F.col("id")).alias("mapping"),
        "source_filename", F.col("timestamp").alias("created_at"),
    )
    files = rows.select("source_filename").distinct()
    return J.mapping_of_file(mappings, files).select("source_filename", F.col("mapping")["id"].alias("mapped"))


@query(
    "first_mapping_stays",
    with_logs("SELECT tool_id AS header_fingerprint, CASE WHEN bool_or(log_type = 'info') THEN 'old' ELSE 'new' END AS source_filename FROM logs GROUP BY 1"),
)
def first_mapping_stays(spark, sf_dir):
    store, rows = _store(spark), logs(spark, sf_dir)

    def named(df, name):
        return df.select("tool_id").distinct().select(
            F.col("tool_id").alias("header_fingerprint"), F.create_map(F.lit("a"), F.lit("unit")).alias("mapping"),
            F.lit(name).alias("source_filename"), F.lit("").alias("created_at"),
        )

    store.save_mappings(named(rows.where(F.col("log_type") == "info"), "old"))
    store.save_mappings(named(rows, "new"))
    return store.read("header_mappings").select("header_fingerprint", "source_filename")


# -- enrichment -----------------------------------------------------------------------------------------

_LABELS_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.doc_id IS NULL THEN 'kept' ELSE 'q' || l.quality END AS ai_summary,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'fault' ELSE 'normal' END AS ai_classification FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _documents_as_logs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cols = {
        "id": F.col("doc_id").cast("string"),
        "ai_summary": F.lit("kept"),
        "source_filename": F.concat("source", F.lit(".log")),
        "raw_message": F.col("text"),
    }
    return docs.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.LOGS])


def _label_results(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("summary"),
        F.when(F.col("toxic") == 1, F.lit("fault")).otherwise(F.lit("normal")).alias("classification"),
        F.lit("").alias("root_cause_hint"),
    )


@query("apply_enrichment", _LABELS_SQL)
def apply_enrichment(spark, sf_dir):
    found = J.apply_enrichment(_documents_as_logs(spark, sf_dir), _label_results(spark, sf_dir))
    return found.select("id", "ai_summary", "ai_classification")


@query("store_enrichment", _LABELS_SQL)
def store_enrichment(spark, sf_dir):
    """The same, written to the table; only folders with a result are rewritten."""
    store = _store(spark)
    store.append("logs", _documents_as_logs(spark, sf_dir))
    store.enrich(_label_results(spark, sf_dir))
    return store.read("logs").select("id", "ai_summary", "ai_classification")


def _severity_scorer(rows: list[dict]):
    """Stand-in for a model: the answer follows from the row."""
    if any(row["log_type"] == "maintenance" for row in rows):
        return "no JSON"
    found = [
        {"id": r["id"], "summary": f"{r['tool_id']}: {r['event_name']}", "classification": "fault" if r["log_type"] == "alarm" else "normal", "root_cause_hint": "x"}
        for r in rows
    ]
    return "```json" + json.dumps(found) + "```"


@query(
    "enrich_in_batches",
    with_logs(
        """SELECT id, CASE WHEN log_type = 'maintenance' THEN 'Parse error' ELSE tool_id || ': ' || event_name END AS summary,
             CASE WHEN log_type = 'alarm' THEN 'fault' ELSE 'normal' END AS classification,
             CASE WHEN log_type = 'maintenance' THEN '' ELSE 'x' END AS root_cause_hint FROM logs"""
    ),
)
def enrich_in_batches(spark, sf_dir):
    """Ten rows a batch; the scorer of maintenance rows answers no JSON."""
    rows = spread(logs(spark, sf_dir))
    unclear = F.col("log_type") == "maintenance"
    scored = U.enrich_batches(rows.where(~unclear), _severity_scorer, batch_size=10)
    return scored.unionByName(U.enrich_batches(rows.where(unclear), lambda batch: "I cannot say.", batch_size=10))


@query(
    "replies_to_records",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS records,
         CASE event_id % 6 WHEN 4 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS first FROM events""",
)
def replies_to_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    form = F.col("event_id") % 6
    wrap = lambda a, b: F.concat(F.lit(a), one, F.lit(b))
    reply = (
        F.when(form == 0, wrap("```json\n[", ', {"id":0}, 7]\n```'))
        .when(form == 1, wrap('{"logs": [', "]}"))
        .when(form == 2, one)
        .when(form == 3, wrap("Here you are: [", ', {"id":1}] - done'))
        .when(form == 4, F.lit("sorry"))
        .otherwise(wrap("```", "```"))
    )
    found = e.select("event_id", U.reply_records(reply).alias("r"))
    return found.select(
        "event_id", F.size("r").alias("records"), F.get_json_object(F.get("r", F.lit(0)), "$.id").alias("first")
    )


@query(
    "explain_record",
    with_logs("SELECT id, tool_id, alarm_code, NULL::VARCHAR AS inner_id, NULL::VARCHAR AS unit FROM logs"),
)
def explain_record(spark, sf_dir):
    """A row as JSON without nulls and without its id."""
    rows = logs(spark, sf_dir).drop("unit")
    text = U.explain_record(rows)
    got = lambda k: F.get_json_object("j", f"$.{k}")
    return rows.select("id", text.alias("j")).select(
        "id", got("tool_id").alias("tool_id"), got("alarm_code").alias("alarm_code"),
        got("id").alias("inner_id"), got("unit").alias("unit"),
    )


# -- review ----------------------------------------------------------------------------------------------


def _for_review(spark, sf_dir):
    """Logs of which the alarms count as read from files of unknown format."""
    rows = logs(spark, sf_dir)
    fmt = F.when(F.col("log_type") == "alarm", F.lit("llm_parsed")).otherwise(F.col("source_format"))
    overflow = F.to_json(F.struct("event_name", "unit", "parameter_value"))
    return rows.withColumns({"source_format": fmt, "metadata": overflow, "row": F.col("id").cast("bigint")})


@query(
    "split_for_review",
    with_logs("""SELECT id, CASE WHEN log_type = 'alarm' THEN 'staged' ELSE 'stored' END AS way FROM logs"""),
)
def split_for_review(spark, sf_dir):
    direct, staged = V.split_for_review(_for_review(spark, sf_dir))
    return direct.select("id", F.lit("stored").alias("way")).unionByName(
        staged.select("id", F.lit("staged").alias("way"))
    )


@query(
    "review_grid",
    with_logs(
        """SELECT id, source_filename AS job_id, timestamp, tool_id, severity, event_name, '' AS parameter_name, CAST(parameter_value AS VARCHAR) AS parameter_value,
             unit, '' AS wafer_id, log_type, raw_message FROM logs WHERE log_type = 'alarm'"""
    ),
)
def review_grid(spark, sf_dir):
    _, staged = V.split_for_review(_for_review(spark, sf_dir))
    return V.review_grid(staged).select(
        "id", "job_id", "timestamp", "tool_id", "severity", "event_name", "parameter_name", "parameter_value",
        "unit", "wafer_id", "log_type", "raw_message",
    )


@query(
    "review_summary",
    with_logs("SELECT source_filename AS job_id, count(*) AS records, count(DISTINCT tool_id) AS tools, count(*) AS flagged FROM logs WHERE log_type = 'alarm' GROUP BY 1"),
)
def review_summary(spark, sf_dir):
    _, staged = V.split_for_review(_for_review(spark, sf_dir))
    return A.review_summary(V.review_grid(staged))


@query("pending_counts", with_logs("SELECT source_filename AS job_id, count(*) AS pending FROM logs WHERE log_type = 'alarm' GROUP BY 1"))
def pending_counts(spark, sf_dir):
    store = _store(spark)
    store.stage(V.split_for_review(_for_review(spark, sf_dir))[1])
    return A.pending_counts(store.read("pending_reviews"))


@query(
    "pending_rows_edited",
    with_logs(
        """SELECT id, CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS BIGINT) AS place, CASE WHEN severity = 'CRITICAL' THEN 'edited' ELSE raw_message END AS raw_message
           FROM logs WHERE log_type = 'alarm' AND source_filename = 'events_20240105.log'"""
    ),
)
def pending_rows_edited(spark, sf_dir):
    """Staged rows of a job in their order, some edited."""
    store = _store(spark)
    rows = _for_review(spark, sf_dir)
    store.stage(V.split_for_review(rows)[1])
    store.edit(
        rows.where(F.col("severity") == "CRITICAL").select("id", F.lit('{"raw_message": "edited"}').alias("record_data"))
    )
    job = store.pending("events_20240105.log").select("id", "seq", F.get_json_object("record_data", "$.raw_message").alias("raw_message"))
    return number_rows(job, ["seq", "id"]).select(
        "id", (F.col(POSITION) + 1).alias("place"), "raw_message"
    )


@query(
    "approve_review",
    with_logs(
        """SELECT id, timestamp, tool_id, CASE WHEN severity = 'CRITICAL' THEN 'WARNING' ELSE severity END AS severity, event_name, unit,
             parameter_value, 'llm_parsed' AS source_format, raw_message FROM logs WHERE log_type = 'alarm' AND source_filename = 'events_20240105.log'"""
    ),
)
def approve_review(spark, sf_dir):
    """A job's rows, as edited, are normalised again and stored; nothing stays staged."""
    store = _store(spark)
    staged = V.split_for_review(_for_review(spark, sf_dir))[1]
    store.stage(staged)
    critical = F.get_json_object("record_data", "$.severity") == "CRITICAL"
    edits = staged.where(critical).select(
        "id", F.replace("record_data", F.lit('"severity":"CRITICAL"'), F.lit('"severity":"Caution"')).alias("record_data")
    )
    store.approve("events_20240105.log", INGEST_TS, edits)
    left = store.pending("events_20240105.log").select("id")
    return store.read("logs").join(left, "id", "left_anti").select(
        "id", "timestamp", "tool_id", "severity", "event_name", "unit", "parameter_value", "source_format", "raw_message"
    )


@query("reject_review", with_logs("SELECT id FROM logs WHERE log_type = 'alarm' AND source_filename <> 'events_20240105.log'"))
def reject_review(spark, sf_dir):
    store = _store(spark)
    store.stage(V.split_for_review(_for_review(spark, sf_dir))[1])
    store.reject("events_20240105.log")
    return store.read("pending_reviews").select("id")


@query(
    "template_from_review",
    with_logs("SELECT DISTINCT source_filename AS job_id, 'event_name,log_type,parameter_value,raw_message,severity,timestamp,tool_id,unit' AS fields FROM logs WHERE log_type = 'alarm'"),
)
def template_from_review(spark, sf_dir):
    _, staged = V.split_for_review(_for_review(spark, sf_dir))
    found = V.template_mapping(staged)
    return found.select("job_id", F.array_join(F.array_sort(F.map_keys("field_mapping")), ",").alias("fields"))


# -- message templates --------------------------------------------------------------------------------------


def _messages(spark, sf_dir):
    """Messages with numbers, ids and hex parts around a few fixed texts."""
    rows = spread(logs(spark, sf_dir))
    number = F.col("id").cast("bigint")
    text = F.concat(
        F.col("event_name"), F.lit(" at "), F.format_string("%.2f", F.col("parameter_value")), F.lit(" units on run "),
        F.col("id"), F.lit(" of A-"), F.col("id"), F.lit("-b code 0xfF"), F.lit(" state: s"), (number % 7).cast("string"),
    )
    return rows.withColumn("raw_message", text)


@query(
    "mask_messages",
    with_logs("SELECT id, event_name || ' at <:FLOAT:> units on run <:NUM:> of <:EQUIPMENT_ID:> code <:HEX:> state: <:VAL:>' AS masked FROM logs"),
)
def mask_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", mask_message(F.col("raw_message")).alias("masked"))


@query(
    "exact_templates",
    with_logs(
        """SELECT event_name || ' at <:FLOAT:> units on run <:NUM:> of <:EQUIPMENT ID:> code <:HEX:> state: <:VAL:>' AS template, count(*) AS n FROM logs GROUP BY 1"""
    ),
)
def exact_templates(spark, sf_dir):
    return T.exact_templates(_messages(spark, sf_dir)).select("template", "n")


_MERGED_SQL = LOGS_SQL + """, mined AS (
  SELECT *, CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 'Pump fault' ELSE event_name END || ' seen by <*> on line <:NUM:>' AS drain_template FROM logs)
"""


def _mined(spark, sf_dir):
    """Messages that differ in one word: one cluster per leading words."""
    rows = spread(logs(spark, sf_dir))
    word = F.translate(F.col("id"), "0123456789", "abcdefghij")
    text = F.concat(F.col("event_name"), F.lit(" seen by "), word, F.lit(" on line "), F.col("id"))
    return T.mine_templates(rows.withColumn("raw_message", text))


@query("mined_templates", _MERGED_SQL + "SELECT id, drain_template FROM mined")
def mined_templates(spark, sf_dir):
    return _mined(spark, sf_dir).select("id", "drain_template")


@query(
    "template_summary",
    _MERGED_SQL + """SELECT drain_template, count(*) AS "count", min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM mined GROUP BY 1""",
)
def template_summary(spark, sf_dir):
    return T.template_summary(_mined(spark, sf_dir)).drop("drain_cluster_id")


@query("template_peers", _MERGED_SQL + "SELECT id, severity FROM mined WHERE event_name = 'Pump fault' AND id <> '0'")
def template_peers(spark, sf_dir):
    """Rows of the same cluster as the first event."""
    return T.template_peers(_mined(spark, sf_dir), "0").select("id", "severity")


@query(
    "mined_templates_many",
    with_logs("SELECT id, 'Pump <*> said <*> at last on <*> line <*>' AS drain_template FROM logs"),
)
def mined_templates_many(spark, sf_dir):
    """As many templates of one shape as rows: four of eight words differ, in as many ways."""
    rows = spread(logs(spark, sf_dir))
    letters = lambda c: F.translate(c, "0123456789", "abcdefghij")
    n = F.col("id").cast("bigint")
    word = lambda k: letters((n * k % 10007 + 1000).cast("string"))
    text = F.concat(F.lit("Pump w"), letters(F.col("id")), F.lit("3 said "), word(3), F.lit(" at last on "), word(7), F.lit(" line "), word(11))
    return T.mine_templates(rows.withColumn("raw_message", text)).select("id", "drain_template")


@query(
    "document_line_templates",
    r"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS m FROM documents),
a AS (SELECT regexp_replace(m, '\b[a-zA-Z0-9_]+-[a-zA-Z0-9_]+-[a-zA-Z0-9_]+\b', '<:EQUIPMENT_ID:>', 'g') AS m FROM lines WHERE m <> ''),
p AS (SELECT m AS masked, regexp_matches(m, '[0-9]|[:=] ') AS marked FROM a)
SELECT trim(regexp_replace(replace(masked, '_', ' '), '[\s\x85\xa0]+', ' ', 'g')) AS template, count(*) AS n
FROM p WHERE NOT marked GROUP BY 1
""",
)
def document_line_templates(spark, sf_dir):
    """Exact templates of the document lines in which only the id mask can match; the other masks use look-arounds that
    SQL does not have, and :func:`mask_messages` checks them."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("raw_message"))
    unmarked = ~F.regexp_replace("raw_message", MASKS[0][0], "<:EQUIPMENT_ID:>").rlike("[0-9]|[:=] ")
    return T.exact_templates(lines.where(unmarked)).select("template", "n").groupBy("template").agg(F.sum("n").alias("n"))


# -- messages --------------------------------------------------------------------------------------------------


def _broker_messages(spark, sf_dir):
    """One JSON message per log row, some without a tool of their own, some arrays, some junk."""
    rows = spread(logs(spark, sf_dir))
    both = rows.select(
        "id",
        "log_type",
        "tool_id",
        json_record(rows).alias("line"),
        json_record(rows.drop("tool_id")).alias("bare"),
    )
    payload = (
        F.when(F.col("log_type") == "info", F.col("bare"))
        .when(F.col("log_type") == "maintenance", F.concat(F.lit("["), "line", F.lit(", "), "line", F.lit("]")))
        .when(F.col("log_type") == "process_step", F.lit("hello there"))
        .otherwise(F.col("line"))
    )
    topic = F.when(F.col("log_type") == "alarm", F.lit("short")).otherwise(
        F.concat(F.lit("fab/tool_logs/"), "tool_id")
    )
    return both.select(
        topic.alias("topic"), payload.cast("binary").alias("payload"), F.col("id").alias("message_key")
    )


_MESSAGES_SQL = LOGS_SQL + """
SELECT tool_id, 'mqtt_' || CASE WHEN log_type = 'alarm' THEN 'MQTT_UNKNOWN' ELSE tool_id END || '.json' AS source_filename, timestamp, severity, event_name, wafer_id
FROM logs, (VALUES (1), (2)) v(n) WHERE log_type <> 'process_step' AND (n = 1 OR log_type = 'maintenance')
"""


@query("broker_messages", _MESSAGES_SQL)
def broker_messages(spark, sf_dir):
    """The stream's expressions on a batch of messages."""
    return M.message_logs(_broker_messages(spark, sf_dir), INGEST_TS).select(
        "tool_id", "source_filename", "timestamp", "severity", "event_name", "wafer_id"
    )


@query(
    "broker_message_warnings",
    with_logs("SELECT 'mqtt_' || tool_id || '.json' AS source_filename, count(*) AS warnings FROM logs WHERE log_type = 'process_step' GROUP BY 1"),
)
def broker_message_warnings(spark, sf_dir):
    notes = M.message_warnings(_broker_messages(spark, sf_dir))
    return notes.groupBy("source_filename").agg(F.count(F.lit(1)).alias("warnings"))


@query(
    "topic_tools",
    with_logs("SELECT id, CASE WHEN log_type = 'alarm' THEN 'MQTT_UNKNOWN' ELSE tool_id END AS tool_id FROM logs"),
)
def topic_tools(spark, sf_dir):
    rows = logs(spark, sf_dir)
    topic = F.when(F.col("log_type") == "alarm", F.concat(F.lit("fab/"), "tool_id")).otherwise(
        F.concat(F.lit("fab/tool_logs/"), "tool_id")
    )
    return rows.select("id", M.topic_tool(topic).alias("tool_id"))


@query("streamed_messages", _MESSAGES_SQL)
def streamed_messages(spark, sf_dir):
    """Messages written as files, read as a stream, appended to the log table and read back."""
    root = scratch_path(spark, "catalog-stream")
    _broker_messages(spark, sf_dir).drop("message_key").write.parquet(f"{root}/in")
    store = LogStore(spark, f"{root}/store")
    store.create()
    source = spark.readStream.schema("topic string, payload binary").parquet(f"{root}/in")
    done = M.stream_ingest(source, store, f"{root}/checkpoint", ingest_ts=INGEST_TS, available_now=True)
    done.awaitTermination()
    return store.read("logs").select("tool_id", "source_filename", "timestamp", "severity", "event_name", "wafer_id")


@query(
    "signatures_of_frames",
    with_logs("SELECT id, 'log:' || left(md5(raw_message), 12) AS signature FROM logs"),
)
def signatures_of_frames(spark, sf_dir):
    rows = logs(spark, sf_dir)
    return rows.select("id", file_signature(F.col("source_filename"), F.col("raw_message")).alias("signature"))


@query(
    "live_view_of_a_stream",
    with_logs("SELECT timestamp, tool_id, severity, wafer_id FROM logs ORDER BY timestamp DESC, id DESC LIMIT 100"),
)
def live_view_of_a_stream(spark, sf_dir):
    """Log rows that come in three batches; the view after the last one."""
    root = scratch_path(spark, "catalog-live")
    rows = logs(spark, sf_dir).withColumn("source_filename", F.concat(F.lit("mqtt_"), "tool_id", F.lit(".json")))
    view = M.LiveView(spark, f"{root}/view", limit=100)
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(S.LOGS).parquet(f"{root}/in")
        view.start(source, f"{root}/checkpoint", available_now=True).awaitTermination()
    return view.read().select("timestamp", "tool_id", "severity", "wafer_id")


@query(
    "messages_once",
    with_logs("SELECT tool_id, severity, event_name, min(event_ts) AS event_ts FROM logs GROUP BY ALL"),
)
def messages_once(spark, sf_dir):
    """Messages of one topic and payload within the watermark come through once."""
    root = scratch_path(spark, "catalog-once")
    first = logs(spark, sf_dir).groupBy("tool_id", "severity", "event_name").agg(F.min("event_ts").alias("event_ts"))
    payload = F.concat_ws("|", "severity", "event_name")
    sent = first.select(
        F.col("tool_id").alias("topic"), payload.alias("payload"), F.col("event_ts").cast("timestamp").alias("timestamp"), "severity", "event_name"
    )
    again = sent.unionByName(sent).unionByName(sent)
    again.write.parquet(f"{root}/in")
    source = spark.readStream.schema(again.schema).parquet(f"{root}/in")
    out = M.distinct_messages(source, late="400 days").writeStream.format("parquet").option("path", f"{root}/out")
    out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(again.schema).parquet(f"{root}/out")
    return found.select(F.col("topic").alias("tool_id"), "severity", "event_name", F.col("timestamp").cast("timestamp_ntz").alias("event_ts"))


@query(
    "enrichment_laid_over",
    with_logs("SELECT id, tool_id, 'second ' || severity AS ai_summary FROM logs"),
)
def enrichment_laid_over(spark, sf_dir):
    """Two results for each row, written beside the logs; reads give the newest."""
    store = _store(spark)
    rows = logs(spark, sf_dir)
    store.append_logs(rows)
    for word in ("first ", "second "):
        store.enrich(rows.select("id", F.concat(F.lit(word), "severity").alias("summary"), F.lit("c").alias("classification"), F.lit("h").alias("root_cause_hint")))
    return store.read("logs").select("id", "tool_id", "ai_summary")


@query(
    "search_of_indexed_files",
    with_logs(
        """SELECT id, timestamp, tool_id, severity, raw_message FROM logs
        WHERE (raw_message ILIKE '%PUMP%user 1_%' OR event_name ILIKE '%PUMP%user 1_%') AND timestamp >= '2024-01-10' AND timestamp <= '2024-03-01'"""
    ),
)
def search_of_indexed_files(spark, sf_dir):
    """Two thirds of the rows are indexed, the others come later; files that cannot have a hit are not opened."""
    store, rows = _store(spark), logs(spark, sf_dir)
    later = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    store.append_logs(rows.where(~later))
    store.index_files()
    store.append_logs(rows.where(later))
    found = store.find(search_term="PUMP%user 1_", start_ts="2024-01-10", end_ts="2024-03-01")
    return found.select("id", "timestamp", "tool_id", "severity", "raw_message")
