"""Views that project the star-schema tables onto the audit schemas.

``Views(spark, folder)`` reads ``<folder>/<table>.parquet``; every method returns a
lazy DataFrame, so only the columns a query uses reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft.operators.ordered import GROUP_ROWS, position
from veridraft.session import tune


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- audits -----------------------------------------------------------------
    def audits(self) -> DataFrame:
        """orders + customer -> audits (one audit per order)."""
        orders, customer = self.table("orders"), self.table("customer")
        key, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("seq"),
            F.concat(F.lit("AUD-"), key.cast("string")).alias("audit_id"),
            F.concat("c_name", F.lit(" "), "c_mktsegment").alias("title"),
            F.expr(
                "concat('doc_', CAST(o_orderkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.pdf'"
                " WHEN 1 THEN '.xlsx' WHEN 2 THEN '.docx' ELSE '.bin' END)"
            ).alias("document_name"),
            F.expr(
                "CASE o_orderstatus WHEN 'P' THEN 'PROCESSING' WHEN 'O' THEN 'REVIEW REQUIRED'"
                " ELSE 'VERIFIED' END"
            ).alias("status"),
            F.expr(
                "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'"
                " WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFORMATIONAL' END"
            ).alias("priority"),
            (total % 101).cast("int").alias("trust_score"),
            F.when(key % 3 == 0, ((total + 17) % 101).cast("int")).alias("reviewed_score"),
            F.col("o_orderdate").cast("timestamp").alias("uploaded_at"),
        )

    # -- flags --------------------------------------------------------------------
    def flags(self, with_ord: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
        """lineitem -> flags. ``ord`` (0-based array position) costs a shuffle, so it is
        added on request."""
        lines = self.table("lineitem")
        ord_column = []
        if with_ord:
            order = ["l_linenumber", "l_partkey", "l_suppkey"]
            chunk = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65536)]
            lines = position(lines, ["l_orderkey"], [F.col(c) for c in order], chunk, "ord", group_rows)
            ord_column = [(F.col("ord") - 1).cast("int").alias("ord")]
        # texts are built after the shuffle for ord, which then moves numbers only
        return lines.select(
            F.concat(F.lit("AUD-"), F.col("l_orderkey").cast("string")).alias("audit_id"),
            F.concat_ws("-", F.lit("FLG"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .alias("flag_id"),
            *ord_column,
            F.expr(
                "CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH'"
                " WHEN l_discount >= 0.04 THEN 'MEDIUM' WHEN l_discount >= 0.02 THEN 'LOW'"
                " ELSE 'INFORMATIONAL' END"
            ).alias("severity"),
            F.expr(
                "CASE WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_returnflag = 'A' THEN 'ACCEPTED'"
                " WHEN l_linestatus = 'F' THEN 'FIXED' ELSE 'DISMISSED' END"
            ).alias("status"),
            (-F.floor(F.col("l_quantity") / 3)).cast("int").alias("impact_score"),
            F.concat(F.lit("SRC-"), F.col("l_suppkey").cast("string")).alias("source_id"),
        )

    def claims(self) -> DataFrame:
        """lineitem -> claims; ids join to flags. Claims of closed lines belong to audits that
        are gone."""
        return self.table("lineitem").select(
            F.expr("concat(CASE WHEN l_linestatus = 'O' THEN 'AUD-' ELSE 'GONE-' END, CAST(l_orderkey AS STRING))")
            .alias("audit_id"),
            F.concat_ws("-", F.lit("CLM"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .alias("claim_id"),
            F.col("l_linenumber").alias("claim_number"),
        )

    def submissions(self) -> DataFrame:
        """Audits offered again as new submissions; some without a title or with text sizes."""
        return self.audits().selectExpr(
            "seq", "concat('NEW-', CAST(seq AS STRING)) AS audit_id",
            "CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 7 = 0 THEN NULL ELSE title END AS title",
            "'Procurement Contract' AS document_type", "'English' AS language",
            "document_name AS file_name",
            "CASE WHEN seq % 2 = 0 THEN '2.4 MB' ELSE CAST(seq * 1000 AS STRING) END AS file_size",
            "uploaded_at AS ts",
        )

    def submission_files(self) -> DataFrame:
        return self.audit_sources(with_ord=True).join(self.sources(), "source_id").selectExpr(
            "replace(audit_id, 'AUD-', 'NEW-') AS audit_id", "ord", "source_id", "name",
            "CASE WHEN group_key % 2 = 0 THEN CAST(size_bytes AS STRING) ELSE '1.2 MB' END AS size",
            "CASE WHEN group_key % 3 = 0 THEN authority WHEN group_key % 3 = 1 THEN '' END AS authority",
            "concat('sha256:', sha2(name, 256)) AS hash",
        )

    def uploads(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('Doc_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_',"
            " CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING),"
            " element_at(array('.pdf', '.PDF', '.docx', '.xls', '.txt', '.exe', '.tar.gz'), l_linenumber % 7 + 1)) AS name",
            "CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS size_bytes",
            "CAST(l_quantity AS INT) % 3 AS batch_size",
        )

    # -- sources ------------------------------------------------------------------
    def sources(self) -> DataFrame:
        """supplier -> source documents."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            F.concat(F.lit("SRC-"), key.cast("string")).alias("source_id"),
            F.expr(
                "concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx'"
                " ELSE '.docx' END)"
            ).alias("name"),
            F.expr(
                "CASE s_suppkey % 4 WHEN 0 THEN 'LATEST_APPROVED' WHEN 1 THEN 'SIGNED_EXECUTED'"
                " WHEN 2 THEN 'SUPERSEDED' ELSE 'DRAFT' END"
            ).alias("authority"),
            (F.lit(1000000) + key * 977777).cast("bigint").alias("size_bytes"),
            F.col("s_nationkey").alias("group_key"),
        )

    def audit_sources(self, with_ord: bool = False) -> DataFrame:
        """Sources per audit: the suppliers of its lines, one row each; those of lines neither
        returned nor refused belong to audits that are gone. The array position (on request)
        follows the supplier key."""
        cited = self.table("lineitem").selectExpr("l_orderkey", "l_returnflag = 'N' AS gone", "l_suppkey").distinct()
        ids = [
            F.expr("concat(CASE WHEN gone THEN 'GONE-' ELSE 'AUD-' END, CAST(l_orderkey AS STRING))").alias("audit_id"),
            F.concat(F.lit("SRC-"), F.col("l_suppkey").cast("string")).alias("source_id"),
        ]
        if not with_ord:
            return cited.select(*ids)
        chunk = [F.floor(F.col("l_suppkey") / 65536)]
        placed = position(cited, ["l_orderkey", "gone"], [F.col("l_suppkey")], chunk, "ord")
        return placed.select(*ids, (F.col("ord") - 1).cast("int").alias("ord"))

    # -- decisions -----------------------------------------------------------------
    def decision_flags(self) -> DataFrame:
        """events -> flags. Some are gone under the id the decisions use, some belong to an
        audit nobody knows."""
        return (
            self.table("events")
            .select(
                F.expr("concat('AUD-', CASE WHEN user_id % 31 = 0 THEN 'none' ELSE CAST(user_id % 10 AS STRING) END)").alias("audit_id"),
                F.expr("concat(CASE WHEN user_id % 29 = 0 THEN 'GONE-' ELSE 'FLG-' END, CAST(user_id AS STRING))").alias("flag_id"),
                F.expr("CAST(-(1 + user_id % 12) AS INT)").alias("impact_score"),
            )
            .distinct()
            .withColumn("status", F.lit("PENDING"))
            .withColumn("reviewer_note", F.lit(None).cast("string"))
        )

    def decision_audits(self) -> DataFrame:
        """The audits the decision log talks about."""
        return (
            self.table("events")
            .select(F.expr("concat('AUD-', CAST(user_id % 10 AS STRING))").alias("audit_id"))
            .distinct()
        )

    def decisions(self) -> DataFrame:
        return decisions_from_events(self.table("events"))

    def rich_flags(self) -> DataFrame:
        """lineitem -> flags with the nested columns (evidence, location, policies ...)."""
        location = (
            "named_struct('type', element_at(array('pdf', 'docx', 'xlsx', 'text', 'unknown'), l_linenumber % 5 + 1),"
            " 'page', CAST(l_quantity AS INT), 'paragraph', CAST(l_quantity AS INT),"
            " 'char_start', CAST(l_suppkey AS INT), 'char_end', CAST(l_suppkey + l_partkey AS INT),"
            " 'sheet', concat('S', CAST(l_linenumber AS STRING)), 'cell', concat('B', CAST(CAST(l_quantity AS INT) AS STRING)))"
        )
        return self.table("lineitem").selectExpr(
            "concat('AUD-', CAST(l_orderkey AS STRING)) AS audit_id",
            "concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id",
            "concat_ws('-', 'CLM', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id",
            "CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH'"
            " WHEN l_discount >= 0.04 THEN 'MEDIUM' WHEN l_discount >= 0.02 THEN 'LOW'"
            " ELSE 'INFORMATIONAL' END AS severity",
            "concat('SRC-', CAST(l_suppkey AS STRING)) AS source_id",
            "CAST(NULL AS STRING) AS source_name",
            "CASE WHEN l_tax > 0.06 THEN 'CONTRADICTED' WHEN l_tax > 0.05 THEN 'SUPPORTED' END AS verification_status",
            f"{location} AS document_location",
            "named_struct('source_name', concat('Supplier ', CAST(l_suppkey AS STRING)),"
            " 'authority', CASE WHEN l_tax < 0.02 THEN '' WHEN l_tax < 0.04 THEN 'Signed' END,"
            " 'freshness_date', CASE WHEN l_linestatus = 'O' THEN '22 Sep 2026' END,"
            " 'quote', CASE l_returnflag WHEN 'R' THEN '  ' WHEN 'A' THEN NULL ELSE 'quoted text' END,"
            " 'relevance_score', CASE WHEN l_tax > 0.03 THEN l_discount * 10 END,"
            f" 'document_location', {location}) AS evidence",
            "CASE WHEN l_tax < 0.03 THEN named_struct('source_name', 'other') END AS counter_evidence",
            "CASE WHEN l_discount > 0.05 THEN named_struct('category',"
            " CASE l_returnflag WHEN 'R' THEN 'Regulatory' WHEN 'A' THEN 'Operational' ELSE 'Commercial' END)"
            " END AS materiality_detail",
            "CASE WHEN l_quantity > 25 THEN filter(array("
            "named_struct('policy_name', concat('POLICY_', CAST(l_linenumber AS STRING)), 'policy_status',"
            " CASE l_returnflag WHEN 'R' THEN 'VIOLATED' WHEN 'A' THEN 'AT_RISK' ELSE 'COMPLIANT' END, 'rationale', l_linestatus),"
            "CASE WHEN l_tax > 0.04 THEN named_struct('policy_name', 'POLICY_TAX', 'policy_status', 'AT_RISK', 'rationale', l_returnflag) END"
            "), x -> x IS NOT NULL) END AS policy_findings",
            "CASE WHEN l_quantity < 10 THEN array(named_struct('confidence',"
            " CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END,"
            " 'requires_human_review', l_linestatus = 'O')) END AS omission_findings",
        )

    def check_items(self) -> DataFrame:
        """lineitem -> check items; those of refused lines point at a flag that is gone."""
        return self.table("lineitem").selectExpr(
            "concat('AUD-', CAST(l_orderkey AS STRING)) AS audit_id",
            "concat_ws('-', 'WTC', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id",
            "concat_ws('-', CASE WHEN l_returnflag = 'R' THEN 'GONE' ELSE 'FLG' END,"
            " l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id",
            "CAST(l_quantity * l_linenumber AS INT) AS `order`",
        )

    def stage_events(self) -> DataFrame:
        return stage_events_from_events(self.table("events"))

    # -- documents -------------------------------------------------------------------
    def doc_flags(self) -> DataFrame:
        """documents + labels -> one flag per line of each document; the array order is not that of the lines."""
        labels = self.table("labels").select("doc_id", "toxic", "quality")
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "claim"))
        return lines.where("claim <> ''").join(labels, "doc_id", "left").selectExpr(
            "doc_id", "concat_ws('-', doc_id, line + 1) AS flag_id",
            "CAST((line + 1) * 7 % 13 * 1000000 + line + 1 AS INT) AS ord", "claim",
            "CASE WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 0 THEN 'HIGH' WHEN line % 3 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
            "CASE WHEN line % 2 = 0 THEN 'PENDING' ELSE 'ACCEPTED' END AS status",
        )

    def passport_requests(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id",
            "concat(CASE WHEN doc_id % 11 = 0 THEN 'TAMPER-' WHEN doc_id % 13 = 0 THEN 'INVALID-'"
            " ELSE 'PASSPORT-' END, CAST(doc_id AS STRING)) AS token",
            "doc_id % 17 = 0 AS is_altered",
            "CAST(doc_id % 4 AS INT) AS unresolved_flags_count",
        )


def decisions_from_events(events: DataFrame) -> DataFrame:
    """events -> decisions; also used on the streaming side."""
    return events.selectExpr(
        "event_id AS decision_id",
        "concat('AUD-', CAST(user_id % 10 AS STRING)) AS audit_id",
        "concat('FLG-', CAST(user_id AS STRING)) AS flag_id",
        "CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'DISMISS'"
        " WHEN 'purchase' THEN 'FIX' ELSE event_type END AS action",
        "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE props END AS note",
        "concat('reviewer-', CAST(event_id % 7 AS STRING)) AS reviewed_by",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


def stage_events_from_events(events: DataFrame) -> DataFrame:
    """events -> stage log: one audit per user and day; also used on the streaming side."""
    return events.selectExpr(
        "concat('AUD-', CAST(user_id AS STRING), '-', CAST(day(ts) AS STRING)) AS audit_id",
        "CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'PARSING'"
        " WHEN 'click' THEN 'INDEXING' WHEN 'error' THEN 'QUEUED'"
        " ELSE CASE WHEN value < 20 THEN 'VERIFYING' ELSE 'COMPLETED' END END AS status",
        "CAST(ts AS TIMESTAMP) AS ts",
    )
