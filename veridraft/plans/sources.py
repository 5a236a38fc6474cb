"""Registered queries: sources and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions import scores, texts
from veridraft.plans.registry import query
from veridraft.session import work_dir
from veridraft.sources import audits as A
from veridraft.sources import uploads as U

SHOWN = ["seq", "audit_id", "title", "document_name", "status", "priority", "trust_score", "reviewed_score"]
SHOWN_SQL = ", ".join(SHOWN)


def _round_trip(v, fmt: str):
    path = work_dir(v.spark, f"audits-{fmt}")
    A.write_table(v.audits(), path, fmt=fmt)
    return A.load_audits(v.spark, path, fmt).select(*SHOWN)


for _fmt in ("parquet", "json"):
    query(f"a01_load_audits_{_fmt}", f"SELECT {SHOWN_SQL} FROM v_audits", ("v_audits",))(
        lambda v, fmt=_fmt: _round_trip(v, fmt)
    )


@query("a02_list_audits", f"SELECT {SHOWN_SQL} FROM v_audits ORDER BY seq DESC", ("v_audits",))
def _(v):
    return A.list_audits(v.audits()).select(*SHOWN)


@query("a03_get_audit", f"SELECT {SHOWN_SQL} FROM v_audits WHERE lower(audit_id) = 'aud-42'", ("v_audits",))
def _(v):
    return A.get_audit(v.audits().select(*SHOWN), "aud-42")


@query(
    "a04_get_flags",
    "SELECT audit_id, ord, flag_id, severity, status, impact_score FROM v_flags"
    " WHERE lower(audit_id) = 'aud-42' ORDER BY ord",
    ("v_flags",),
)
def _(v):
    columns = ["audit_id", "ord", "flag_id", "severity", "status", "impact_score"]
    return A.children_of(v.audits(), v.flags(with_ord=True), "aud-42").select(*columns)


@query(
    "a04_get_claims",
    "SELECT audit_id, claim_id, claim_number FROM v_claims WHERE lower(audit_id) = 'aud-42' ORDER BY claim_number",
    ("v_claims",),
)
def _(v):
    return A.children_of(v.audits(), v.claims(), "aud-42", order="claim_number")


N = D.NEW_AUDIT


@query(
    "a05_create_audits",
    f"""SELECT seq, audit_id, CASE WHEN title <> '' THEN title ELSE regexp_replace(file_name, '\\.[^/.]+$', '') END AS title,
        file_name AS document_name, '{N["status"]}' AS status, '{N["processing_status"]}' AS processing_status,
        '{N["priority"]}' AS priority, {N["trust_score"]} AS trust_score, 100 AS initial_score,
        '{N["risk_band"]}' AS risk_band, CAST(1 AS BIGINT) AS findings_count,
        CASE WHEN file_size LIKE '% MB' THEN file_size ELSE '{N["document_size"]}' END AS document_size
        FROM v_new""",
    ("v_audits", "v_new"),
)
def _(v):
    new = A.create_audits(v.submissions(), v.submission_files())["audits"]
    return new.select(
        "seq", "audit_id", "title", "document_name", "status", "processing_status", "priority",
        "trust_score", "initial_score", "risk_band", "findings_count",
        F.col("ai_document.size").alias("document_size"),
    )


@query(
    "a05_create_sources",
    f"""SELECT audit_id, ord, source_id, name, type, size_bytes, authority,
        CASE WHEN authority = 'LATEST_APPROVED' THEN 'Latest Approved Document' ELSE 'Signed Execution File' END AS authority_label,
        version
        FROM (SELECT audit_id, ord, source_id, name,
          CASE WHEN name LIKE '%.pdf' THEN 'Purchase Order' WHEN name LIKE '%.xlsx' THEN 'Commercial Schedule' ELSE 'Policy Doc' END AS type,
          CASE WHEN size LIKE '% MB' THEN CAST({D.DEFAULT_SIZE_BYTES} AS BIGINT) ELSE CAST(size AS BIGINT) END AS size_bytes,
          CASE WHEN authority <> '' THEN authority WHEN ord = 0 THEN 'LATEST_APPROVED' ELSE 'SIGNED_EXECUTED' END AS authority,
          'v1.0' AS version FROM v_new_files WHERE audit_id IN (SELECT audit_id FROM v_new)) x""",
    ("v_audits", "v_new", "v_sources", "v_audit_sources", "v_new_files"),
)
def _(v):
    new = A.create_audits(v.submissions(), v.submission_files())["source_documents"]
    return new.select(
        "audit_id", "ord", "source_id", "name", "type", "size_bytes", "authority", "authority_label", "version"
    )


@query(
    "a05_create_flags",
    f"""SELECT n.audit_id, concat('FLG-', n.audit_id, '-1') AS flag_id, concat('CLM-', n.audit_id, '-1') AS claim_id,
        '{N["flag_severity"]}' AS severity, '{N["flag_status"]}' AS status, {N["flag_impact"]} AS impact_score,
        coalesce(f.source_id, '{N["evidence_source_id"]}') AS source_id, coalesce(f.name, '{N["evidence_source_name"]}') AS source_name
        FROM v_new n LEFT JOIN (SELECT * FROM v_new_files WHERE ord = 0) f ON n.audit_id = f.audit_id""",
    ("v_audits", "v_new", "v_sources", "v_audit_sources", "v_new_files"),
)
def _(v):
    new = A.create_audits(v.submissions(), v.submission_files())["flags"]
    return new.select(
        "audit_id", "flag_id", "claim_id", "severity", "status", "impact_score",
        F.col("evidence.source_id").alias("source_id"), F.col("evidence.source_name").alias("source_name"),
    )


@query(
    "a05_create_children",
    """SELECT audit_id, t.kind, t.ord FROM v_new CROSS JOIN
       (VALUES ('claim', 0), ('check_item', 0), ('waterfall', 0), ('waterfall', 1)) t(kind, ord)""",
    ("v_audits", "v_new"),
)
def _(v):
    new = A.create_audits(v.submissions(), v.submission_files())
    claims = new["claims"].select("audit_id", F.lit("claim").alias("kind"), F.lit(0).alias("ord"))
    items = new["check_items"].select("audit_id", F.lit("check_item").alias("kind"), "ord")
    steps = new["waterfall"].select("audit_id", F.lit("waterfall").alias("kind"), "ord")
    return claims.unionByName(items).unionByName(steps)


@query(
    "a06_title_or_stem",
    r"""SELECT audit_id, CASE WHEN title <> '' THEN title ELSE regexp_replace(file_name, '\.[^/.]+$', '') END AS shown_title
        FROM v_new""",
    ("v_audits", "v_new"),
)
def _(v):
    return v.submissions().select(
        "audit_id", texts.title_or_stem(F.col("title"), F.col("file_name")).alias("shown_title")
    )


@query(
    "a07_source_type",
    """SELECT name, CASE WHEN suffix(name, '.pdf') THEN 'Purchase Order' WHEN suffix(name, '.xlsx') THEN 'Commercial Schedule'
       ELSE 'Policy Doc' END AS source_type FROM v_uploads""",
    ("v_uploads",),
)
def _(v):
    return v.uploads().select("name", texts.source_type(F.col("name")).alias("source_type"))


@query(
    "a08_default_authority",
    """SELECT audit_id, ord, source_id, CASE WHEN authority <> '' THEN authority WHEN ord = 0 THEN 'LATEST_APPROVED'
       ELSE 'SIGNED_EXECUTED' END AS authority FROM v_new_files""",
    ("v_sources", "v_audit_sources", "v_new_files"),
)
def _(v):
    return v.submission_files().select(
        "audit_id", "ord", "source_id",
        texts.default_authority(F.col("authority"), F.col("ord")).alias("authority"),
    )


@query(
    "a09_authority_label",
    """SELECT source_id,
       CASE WHEN authority = 'LATEST_APPROVED' THEN 'Latest Approved Document' ELSE 'Signed Execution File' END AS file_label,
       CASE authority WHEN 'LATEST_APPROVED' THEN '✓ Latest Approved' WHEN 'SIGNED_EXECUTED' THEN '✓ Signed & Executed'
         WHEN 'SUPERSEDED' THEN 'Older / Superseded' WHEN 'DRAFT' THEN 'Preliminary Draft' END AS card_label
       FROM v_sources""",
    ("v_sources",),
)
def _(v):
    return v.sources().select(
        "source_id",
        scores.label_of(F.col("authority"), "authority_file").alias("file_label"),
        scores.label_of(F.col("authority"), "authority_card").alias("card_label"),
    )


@query(
    "a10_size_or_default",
    """SELECT audit_id, source_id, CASE WHEN size LIKE '% MB' THEN CAST(1240000 AS BIGINT) ELSE CAST(size AS BIGINT) END AS size_bytes
       FROM v_new_files""",
    ("v_sources", "v_audit_sources", "v_new_files"),
)
def _(v):
    return v.submission_files().select(
        "audit_id", "source_id", texts.size_or_default(F.col("size")).alias("size_bytes")
    )


_REASON = """CASE WHEN NOT regexp_matches(lower(name), '\\.(pdf|docx|xlsx|xls|txt)$')
      THEN 'Unsupported file format. Please upload PDF, DOCX, XLSX, or TXT.'
     WHEN size_bytes > 52428800 THEN 'File size exceeds the 50MB limit.' END"""


@query("a11_uploads_accepted", f"SELECT name, size_bytes FROM v_uploads WHERE {_REASON} IS NULL", ("v_uploads",))
def _(v):
    accepted, _rejected = U.validate_uploads(v.uploads())
    return accepted.select("name", "size_bytes")


@query(
    "a11_uploads_rejected",
    f"SELECT name, size_bytes, {_REASON} AS reason FROM v_uploads WHERE {_REASON} IS NOT NULL",
    ("v_uploads",),
)
def _(v):
    _accepted, rejected = U.validate_uploads(v.uploads())
    return rejected.select("name", "size_bytes", "reason")


@query(
    "a11_uploads_multi_path",
    f"SELECT name, batch_size, {_REASON} AS reason FROM v_uploads WHERE batch_size <= 1 AND {_REASON} IS NOT NULL",
    ("v_uploads",),
)
def _(v):
    _accepted, rejected = U.validate_uploads(v.uploads(), validate_multi=False)
    return rejected.select("name", "batch_size", "reason")


@query(
    "a12_upload_manifest",
    f"""SELECT concat('DOC-', substr(h, 1, 16)) AS id, concat(doc_id, kind) AS filename, CAST(strlen(body) AS BIGINT) AS size_bytes,
        CASE kind WHEN '.txt' THEN 'text/plain' ELSE '{D.DEFAULT_MIME}' END AS mime_type, concat('sha256:', h) AS hash
        FROM (SELECT doc_id, kind, body, sha256(body) AS h FROM (
          SELECT doc_id, CASE WHEN lang = 'en' THEN '.txt' ELSE '.bin' END AS kind,
            CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END AS body FROM documents) a) b""",
)
def _(v):
    # documents as uploaded files; those of every tenth id are empty and have no content row
    files = v.table("documents").selectExpr(
        "concat('/uploads/', doc_id, CASE WHEN lang = 'en' THEN '.txt' ELSE '.bin' END) AS path",
        "encode(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END, 'utf-8') AS content",
    )
    listed = files.select("path", F.octet_length("content").alias("length"))
    return U.upload_manifest(listed, files.where("octet_length(content) > 0"), {"txt": "text/plain"})


@query(
    "a13_format_size",
    "SELECT source_id, printf('%.1f MB', size_bytes / 1048576.0) AS size_text FROM v_sources",
    ("v_sources",),
)
def _(v):
    return v.sources().select("source_id", texts.format_size(F.col("size_bytes")).alias("size_text"))


@query(
    "a13_format_size_text",
    "SELECT audit_id, source_id, CASE WHEN size LIKE '% MB' THEN size ELSE printf('%.1f MB', CAST(size AS DOUBLE) / 1048576.0) END AS size_text FROM v_new_files",
    ("v_sources", "v_audit_sources", "v_new_files"),
)
def _(v):
    return v.submission_files().select(
        "audit_id", "source_id", texts.format_size_text(F.col("size")).alias("size_text")
    )


def _source_edits(v):
    """Edits taken from the supplier table: every source is re-rated, removed or copied."""
    return v.sources().selectExpr(
        "CASE group_key % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'REMOVE' ELSE 'AUTHORITY' END AS op",
        "CASE WHEN group_key % 4 = 0 THEN concat(source_id, '-copy') ELSE source_id END AS source_id",
        "name", "CASE WHEN group_key % 4 = 2 THEN 'DRAFT' ELSE 'SUPERSEDED' END AS authority", "size_bytes",
    )


@query(
    "a14_apply_source_edits",
    """SELECT source_id, name, CASE group_key % 4 WHEN 2 THEN 'DRAFT' WHEN 3 THEN 'SUPERSEDED' ELSE authority END AS authority, size_bytes
       FROM v_sources WHERE group_key % 4 <> 1
       UNION ALL SELECT concat(source_id, '-copy'), name, 'LATEST_APPROVED', size_bytes FROM v_sources WHERE group_key % 4 = 0""",
    ("v_sources",),
)
def _(v):
    return U.apply_source_edits(v.sources(), _source_edits(v))
