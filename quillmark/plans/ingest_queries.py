"""Queries over snapshots, chunks' text scalars and the job log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import ingest as I  # noqa: E741
from quillmark.sources.tables import chunks, files, load, rel_path, snapshots

PATH = "concat(source, '/', lang, '/', doc_id, '.txt')"
CHUNKS = """chunks AS (SELECT doc_id, kb_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, line AS text FROM
    (SELECT doc_id, source AS kb_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> '')"""
SNAPSHOTS = f"""old AS (SELECT doc_id AS file_key, {PATH} AS rel_path, sha256(text) AS checksum, n_chars AS size,
    CASE WHEN doc_id % 20 = 4 THEN 'deleted' WHEN doc_id % 20 = 6 THEN 'skipped' ELSE 'indexed' END AS status,
    CASE WHEN doc_id % 20 = 8 THEN '' ELSE sha256(text) END AS indexed_version, CASE WHEN doc_id % 20 = 9 THEN 'text@1' ELSE 'text@2' END AS indexed_profile
    FROM documents WHERE doc_id % 10 <> 3),
  changed AS (SELECT *, CASE WHEN doc_id % 10 = 5 THEN text || ' changed' ELSE text END AS body FROM documents WHERE doc_id % 10 <> 7),
  new AS (SELECT doc_id AS file_key, CASE WHEN doc_id % 20 = 1 THEN 'moved/' || {PATH} ELSE {PATH} END AS rel_path, sha256(body) AS checksum, length(body) AS size, 'text@2' AS profile FROM changed)"""
APPROX = r"(length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) + greatest(1, (length({0}) - length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))) // 4))"
JOBS = """jobs AS (SELECT event_id AS job_id, 'kb' || (user_id % 7) AS kb_id, 'file-' || (user_id % 50) || ':' || event_type AS dedupe_key, (epoch_us(ts) // 1000000) AS created_at,
    CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status, event_id % 3 AS priority, (event_id % 5)::int AS attempts,
    (epoch_us(ts) // 1000000) + (event_id % 5) * 60 AS run_after, (epoch_us(ts) // 1000000) + 300 AS lease_until FROM events)"""
NOW = 1_704_500_000


def jobs(spark, d):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("kb"), F.col("user_id") % 7).alias("kb_id"),
        F.concat(F.lit("file-"), F.col("user_id") % 50, F.lit(":"), F.col("event_type")).alias("dedupe_key"),
        at.alias("created_at"),
        F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        (F.col("event_id") % 3).alias("priority"),
        (F.col("event_id") % 5).cast("int").alias("attempts"),
        (at + (F.col("event_id") % 5) * 60).alias("run_after"),
        (at + 300).alias("lease_until"),
    )


def median_time(spark, d):
    return load(spark, d, "events").select(F.floor(F.avg(F.unix_timestamp(F.col("ts").cast("timestamp")))).cast("long").alias("now"))


def stable_file_key(spark, d):
    return files(spark, d).select("doc_id", T.stable_key(F.concat_ws(":", "kb_id", "rel_path")).alias("file_key"))


def path_rules(spark, d):
    docs = load(spark, d, "documents")
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, ".cache//").when(F.col("doc_id") % 5 == 1, "a\\b//").otherwise(""), rel_path(), F.when(F.col("doc_id") % 3 == 0, ".bin").otherwise(""))
    return docs.select("doc_id", T.normal_path(path).alias("path"), F.array_join(T.ancestors(path), "|").alias("folders"), T.supported(path).alias("supported"), T.skipped(T.normal_path(path)).alias("skipped"))


def document_types(spark, d):
    docs = load(spark, d, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("f"), F.col("doc_id"))).otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".MD")))
    mime = F.element_at(F.array(*map(F.lit, ("application/pdf", "text/plain", "application/x", "a/wordprocessing"))), (F.col("doc_id") % 16 / 4).cast("int") + 1)
    return docs.select(T.document_type(name, mime).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def change_classify(spark, d):
    return I.classify_changes(*snapshots(spark, d))


def scan_stats(spark, d):
    return change_classify(spark, d).groupBy("change").agg(F.count("*").alias("n"), F.count("job").alias("jobs"))


def move_detect(spark, d):
    return I.detect_moves(*snapshots(spark, d))


def delete_detect(spark, d):
    old, new = snapshots(spark, d)
    return I.missing_files(old.where("status <> 'deleted'"), new).select("file_key", "rel_path")


def settle_delay(spark, d):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = load(spark, d, "events").crossJoin(F.broadcast(median_time(spark, d)))
    flag = I.still_settling(at, F.col("now"), 86_400)
    return rows.groupBy("event_type").agg(F.sum(flag.cast("long")).alias("deferred"), F.sum((~flag).cast("long")).alias("ready"))


def checksum_reuse(spark, d):
    old, new = snapshots(spark, d)
    known = old.withColumn("mtime", F.col("file_key") * 7 % 1000)
    seen = new.withColumn("mtime", F.when(F.col("file_key") % 6 == 0, F.lit(5000)).otherwise(F.col("file_key") * 7 % 1000))
    return I.reuse_checksums(seen, known).groupBy("hashed").agg(F.count("*").alias("n"), F.min("checksum").alias("first"))


def publication_guard(spark, d):
    points = chunks(spark, d).select(F.concat_ws("-", "doc_id", "chunk_index").alias("point_id"), "doc_id", F.sha2("text", 256).alias("text_sha"))
    ledger = points.where("doc_id % 6 <> 1").select(
        "point_id", F.when(F.col("doc_id") % 6 == 2, "retired").otherwise("active").alias("status"), F.when(F.col("doc_id") % 6 == 3, F.lit("x")).otherwise(F.col("text_sha")).alias("text_sha"), F.lit("v1").alias("content_version")
    )
    state = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 4, "deleted").otherwise("indexed").alias("status"), F.when(F.col("doc_id") % 7 == 0, "v2").otherwise("v1").alias("indexed_version"))
    return I.published(points, ledger, state).groupBy("doc_id").agg(F.count("*").alias("points"))


def document_delta(spark, d):
    old, new = (chunks(spark, d).where(w).select("doc_id", F.sha2(t, 256).alias("chunk_sha")) for w, t in (
        ("doc_id % 10 <> 3", F.col("text")),
        ("doc_id % 10 <> 7", F.when((F.col("doc_id") % 10 == 5) & (F.col("chunk_index") % 2 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))),
    ))
    return I.document_delta(old, new)


def retention_candidates(spark, d):
    points = chunks(spark, d).select("doc_id", F.lit("v1").alias("content_version"), (F.col("doc_id") % 3 == 0).alias("is_active"), (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("inactive_at"))
    return I.expired(points, 500_000)


def superseded_versions(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"))
    return I.superseded(rows, ["kb_id"], [F.desc("at"), F.desc("version")], 3).select("kb_id", "version")


def job_dedupe(spark, d):
    return I.enqueue(jobs(spark, d)).select("job_id", "dedupe_key", "status")


def job_claim_order(spark, d):
    return I.claim_order(jobs(spark, d), NOW).select("kb_id", "job_id", "claim")


def retry_backoff(spark, d):
    return jobs(spark, d).where("status = 'failed'").select("job_id", I.backoff(30, F.col("attempts"), 300).alias("delay"))


def stage_elapsed(spark, d):
    rows = I.stage_elapsed(jobs(spark, d), "dedupe_key", "created_at", "job_id")
    return rows.groupBy("kb_id").agg(F.count("elapsed").alias("steps"), F.sum("elapsed").alias("seconds"), F.max("elapsed").alias("longest"))


def latest_failure(spark, d):
    rows = jobs(spark, d).where("status = 'failed'").groupBy("dedupe_key")
    return rows.agg(F.max(F.struct("created_at", "job_id")).alias("last")).select("dedupe_key", "last.job_id", "last.created_at")


def rebuild_policy(spark, d):
    rows = load(spark, d, "documents").groupBy(F.col("source").alias("kb_id")).agg(
        F.max(F.col("doc_id") % 40).alias("age_days"), F.sum((F.col("doc_id") % 10 == 3).cast("long")).alias("new_chunks"), F.count("*").alias("total_chunks"), F.sum((F.col("doc_id") % 7 == 0).cast("long")).alias("changed_docs"))
    return I.rebuild_policy(rows, days=20, chunks=40, ratio=0.2).select("kb_id", "policy")


def language_tags(spark, d):
    return load(spark, d, "documents").groupBy(T.language("text").alias("tag"), "lang").agg(F.count("*").alias("n"))


def chunk_diagnostics(spark, d):
    rows = chunks(spark, d).withColumn("tokens", T.approx_tokens("text"))
    return rows.groupBy("kb_id").agg(
        F.count("*").alias("n_chunks"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 4).alias("mean"), F.round(F.stddev_pop("tokens"), 4).alias("deviation"),
        F.sum((F.col("tokens") < 50).cast("long")).alias("tiny"), F.sum((F.col("tokens") > 400).cast("long")).alias("oversize"))


def sentence_split(spark, d):
    rows = load(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(-1)).alias("last"))


def line_chunks(spark, d):
    """Lines packed into chunks of about 400 tokens by the running sum of their tokens."""
    from pyspark.sql import Window

    rows = chunks(spark, d).withColumn("tokens", T.approx_tokens("text"))
    before = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    rows = rows.withColumn("part", F.floor(before / 400))
    return rows.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("body"), F.sum("tokens").alias("tokens")).select(
        "doc_id", "part", "tokens", F.sha2("body", 256).alias("chunk_sha"))


QUERIES = {f.__name__: f for f in (
    stable_file_key, path_rules, document_types, change_classify, scan_stats, move_detect, delete_detect, settle_delay, checksum_reuse, publication_guard, document_delta, retention_candidates,
    superseded_versions, job_dedupe, job_claim_order, retry_backoff, stage_elapsed, latest_failure, rebuild_policy, language_tags, chunk_diagnostics, sentence_split, line_chunks,
)}

CHANGES = f"""WITH {SNAPSHOTS}, diff AS (SELECT coalesce(o.file_key, n.file_key) AS file_key, CASE WHEN n.checksum IS NULL THEN 'deleted' WHEN o.checksum IS NULL THEN 'new'
    WHEN o.status = 'deleted' AND o.checksum = n.checksum AND o.size = n.size AND o.indexed_version = n.checksum THEN 'metadata_changed' WHEN o.status = 'deleted' THEN 'new'
    WHEN o.checksum <> n.checksum OR o.size <> n.size THEN 'content_changed' WHEN o.status = 'skipped' THEN 'skipped' WHEN o.indexed_version <> n.checksum THEN 'needs_parse'
    WHEN o.indexed_profile <> n.profile THEN 'parser_changed' WHEN o.rel_path <> n.rel_path THEN 'metadata_changed' ELSE 'unchanged' END AS change
    FROM old o FULL JOIN new n ON o.file_key = n.file_key), found AS (SELECT *, CASE WHEN change IN ('new', 'content_changed', 'needs_parse', 'parser_changed') THEN 'parse'
    WHEN change = 'metadata_changed' THEN 'metadata_update' WHEN change = 'deleted' THEN 'delete' END AS job FROM diff)"""
RAW_PATH = rf"(CASE doc_id % 5 WHEN 0 THEN '.cache//' WHEN 1 THEN 'a\b//' ELSE '' END || {PATH} || CASE WHEN doc_id % 3 = 0 THEN '.bin' ELSE '' END)"

SQL = {
    "stable_file_key": f"SELECT doc_id, ('0x' || substr(sha256(source || ':' || {PATH}), 1, 15))::bigint AS file_key FROM documents",
    "path_rules": rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(replace({RAW_PATH}, '\', '/'), '/+', '/', 'g'), '/') AS path FROM documents)
        SELECT doc_id, path, array_to_string(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')), '|') AS folders,
        path LIKE '%.txt' AS supported, path LIKE '.%' AS skipped FROM p""",
    "document_types": """SELECT CASE WHEN doc_id % 4 <> 0 THEN 'md' WHEN doc_id % 16 // 4 = 0 THEN 'pdf' WHEN doc_id % 16 // 4 = 1 THEN 'txt' WHEN doc_id % 16 // 4 = 2 THEN 'unknown' ELSE 'docx' END AS kind,
        count(*) AS n FROM documents GROUP BY 1""",
    "change_classify": f"{CHANGES} SELECT file_key, change, job FROM found",
    "scan_stats": f"{CHANGES} SELECT change, count(*) AS n, count(job) AS jobs FROM found GROUP BY change",
    "move_detect": f"""WITH {SNAPSHOTS}, unseen AS (SELECT * FROM new WHERE rel_path NOT IN (SELECT rel_path FROM old)), gone AS (SELECT * FROM old WHERE rel_path NOT IN (SELECT rel_path FROM new))
        SELECT g.rel_path AS from_path, u.rel_path AS to_path, u.checksum FROM unseen u JOIN gone g USING (checksum)
        WHERE (SELECT count(*) FROM unseen x WHERE x.checksum = u.checksum) = 1 AND (SELECT count(*) FROM gone x WHERE x.checksum = u.checksum) = 1""",
    "delete_detect": f"WITH {SNAPSHOTS} SELECT file_key, rel_path FROM old WHERE status <> 'deleted' AND file_key NOT IN (SELECT file_key FROM new)",
    "settle_delay": """WITH t AS (SELECT event_type, (epoch_us(ts) // 1000000) AS moment, (SELECT floor(avg(epoch_us(ts) // 1000000))::bigint FROM events) AS present FROM events)
        SELECT event_type, count_if(abs(present - moment) < 86400)::bigint AS deferred, count_if(abs(present - moment) >= 86400)::bigint AS ready FROM t GROUP BY event_type""",
    "checksum_reuse": f"""WITH {SNAPSHOTS}, j AS (SELECT n.checksum AS found, o.checksum AS kept, coalesce(o.size = n.size AND n.file_key % 6 <> 0 AND o.file_key * 7 % 1000 = n.file_key * 7 % 1000, false) AS same
        FROM new n LEFT JOIN old o ON o.rel_path = n.rel_path) SELECT NOT same AS hashed, count(*) AS n, min(CASE WHEN same THEN kept ELSE found END) AS first FROM j GROUP BY 1""",
    "publication_guard": f"WITH {CHUNKS} SELECT doc_id, count(*) AS points FROM chunks WHERE doc_id % 6 NOT IN (1, 2, 3) AND doc_id % 5 <> 4 AND doc_id % 7 <> 0 GROUP BY doc_id",
    "document_delta": f"""WITH {CHUNKS}, o AS (SELECT DISTINCT doc_id, sha256(text) AS s FROM chunks WHERE doc_id % 10 <> 3),
        n AS (SELECT DISTINCT doc_id, sha256(CASE WHEN doc_id % 10 = 5 AND chunk_index % 2 = 0 THEN text || '!' ELSE text END) AS s FROM chunks WHERE doc_id % 10 <> 7),
        a AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, count(o.s) AS old, count(n.s) AS new, count_if(o.s IS NOT NULL AND n.s IS NOT NULL) AS kept FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.s = n.s GROUP BY 1)
        SELECT doc_id, CASE WHEN old = 0 THEN 'added' WHEN new = 0 THEN 'removed' ELSE 'modified' END AS kind, (new - kept)::bigint AS new_chunks, (old - kept)::bigint AS removed_chunks
        FROM a WHERE old = 0 OR new = 0 OR kept < old OR kept < new""",
    "retention_candidates": f"WITH {CHUNKS} SELECT doc_id, 'v1' AS content_version, count(*) AS points, min(doc_id * 1000 + chunk_index) AS oldest FROM chunks WHERE doc_id % 3 <> 0 AND doc_id * 1000 + chunk_index < 500000 GROUP BY doc_id",
    "superseded_versions": "SELECT o_custkey AS kb_id, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3",
    "job_dedupe": f"WITH {JOBS} SELECT job_id, dedupe_key, status FROM jobs WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at, job_id) = 1",
    "job_claim_order": f"""WITH {JOBS} SELECT kb_id, job_id, row_number() OVER (PARTITION BY kb_id ORDER BY priority, created_at, job_id) AS claim FROM jobs
        WHERE (status = 'queued' AND run_after <= {NOW}) OR (status = 'running' AND lease_until < {NOW})""",
    "retry_backoff": f"WITH {JOBS} SELECT job_id, least(300.0::double, 30.0::double * pow(2.0::double, attempts)) AS delay FROM jobs WHERE status = 'failed'",
    "stage_elapsed": f"""WITH {JOBS}, e AS (SELECT kb_id, lead(created_at) OVER (PARTITION BY dedupe_key ORDER BY created_at, job_id) - created_at AS elapsed FROM jobs)
        SELECT kb_id, count(elapsed) AS steps, sum(elapsed)::bigint AS seconds, max(elapsed) AS longest FROM e GROUP BY kb_id""",
    "latest_failure": f"WITH {JOBS} SELECT dedupe_key, job_id, created_at FROM jobs WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at DESC, job_id DESC) = 1",
    "rebuild_policy": """WITH s AS (SELECT source AS kb_id, max(doc_id % 40) AS age, count_if(doc_id % 10 = 3) AS new, count(*) AS total, count_if(doc_id % 7 = 0) AS changed FROM documents GROUP BY source)
        SELECT kb_id, CASE WHEN age >= 20 AND (new >= 40 OR new / total >= 0.2) THEN 'full' WHEN changed > 0 THEN 'append' ELSE 'none' END AS policy FROM s""",
    "language_tags": r"""WITH c AS (SELECT lang, length(regexp_replace(substr(text, 1, 4000), '[^\x{4e00}-\x{9fff}]', '', 'g')) AS c, length(regexp_replace(substr(text, 1, 4000), '[^A-Za-z]', '', 'g')) AS l FROM documents)
        SELECT CASE WHEN c = 0 AND l = 0 THEN 'und' WHEN c > 0 AND l > 0 AND least(c, l) / greatest(c, l) >= 0.25 THEN 'mixed' WHEN c >= l THEN 'zh' ELSE 'en' END AS tag, lang, count(*) AS n FROM c GROUP BY 1, 2""",
    "chunk_diagnostics": f"""WITH {CHUNKS}, t AS (SELECT kb_id, {APPROX.format("text")} AS tokens FROM chunks)
        SELECT kb_id, count(*) AS n_chunks, min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 4) AS mean, round(stddev_pop(tokens), 4) AS deviation,
        count_if(tokens < 50)::bigint AS tiny, count_if(tokens > 400)::bigint AS oversize FROM t GROUP BY kb_id""",
    "sentence_split": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents) SELECT doc_id, len(p)::bigint AS n, p[-1] AS last FROM s""",
    "line_chunks": f"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_index, text, {APPROX.format("text")} AS tokens FROM chunks),
        p AS (SELECT *, floor((sum(tokens) OVER (PARTITION BY doc_id ORDER BY chunk_index) - tokens) / 400)::bigint AS part FROM t)
        SELECT doc_id, part, sum(tokens)::bigint AS tokens, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS chunk_sha FROM p GROUP BY doc_id, part""",
}
