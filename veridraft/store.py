"""The audit tables of one folder, with the calls an application makes on them.

Base tables are append-only; reviewer decisions are a log with a table of the flags' states, both
in levelled runs dealt to buckets by audit. Current flags and scores are views: base tables plus
states.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft import schemas
from veridraft.functions import scores
from veridraft.functions.columns import or_default
from veridraft.operators import decisions as D
from veridraft.operators import evidence, passports
from veridraft.operators.scoring import rescore_decided
from veridraft.session import tune
from veridraft.sources import audits as A
from veridraft.streaming.rescoring import DecisionLog


def _widened(part: Column, kind: T.StructType) -> Column:
    """A struct with the fields of ``kind``; those that ``part`` lacks are null."""
    fields = [part["source_id"] if f.name == "source_id" else F.lit(None).cast(f.dataType) for f in kind.fields]
    return F.when(part.isNotNull(), F.struct(*(c.alias(f.name) for c, f in zip(fields, kind.fields))))


class AuditStore:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = tune(spark), root.rstrip("/"), fmt

    def table(self, name: str) -> DataFrame:
        """A stored table; empty while nothing has been written to it."""
        try:
            return A.load_table(self.spark, name, f"{self.root}/{name}", self.fmt)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schemas.TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        if "audit_key" in self.table(name).columns:
            rows = A.with_key(rows)
        A.write_table(rows, f"{self.root}/{name}", "append", self.fmt)

    # -- audits --------------------------------------------------------------------
    def create_audits(self, submissions: DataFrame, files: DataFrame, template: dict | None = None) -> None:
        """A05. Children first, so that a visible audit is complete."""
        new = A.create_audits(submissions, files, template)
        for name in ("source_documents", "claims", "flags", "check_items", "waterfall", "audits"):
            self.append(name, new[name])

    def audits(self) -> DataFrame:
        """A02. Newest first, with current scores."""
        return A.list_audits(self.current_audits())

    def audit(self, audit_id: str, strict: bool = True) -> DataFrame:
        """A03. Reads the audit's own rows only: stored keys reach all three scans."""
        return A.get_audit(self.current_audits(audit_id), audit_id, strict)

    def audit_status(self, audit_id: str) -> DataFrame:
        """A23."""
        return self.audit(audit_id).select(
            "audit_id", "status",
            or_default(F.col("processing_status"), "COMPLETED").alias("processing_status"),
            scores.progress_percent(F.col("status")).alias("progress_percent"),
            scores.current_stage(F.col("status")).alias("current_stage"),
        )

    def claims(self, audit_id: str) -> DataFrame:
        """A04."""
        return A.children_of(self.table("audits"), self.table("claims"), audit_id, "claim_number")

    def flags(self, audit_id: str) -> DataFrame:
        """A04. Flags as the decisions left them."""
        return A.children_of(self.table("audits"), self.current_flags(audit_id), audit_id)

    def record_findings(self, findings: DataFrame) -> None:
        """E3. Store the flags of ``verdict_flags`` behind those their audits have, so that they can be
        decided on. Flags that are stored already stay as they are; audits are not created."""
        new = A.with_key(findings)
        keys = new.select("audit_key").distinct()
        stored = self.table("flags").join(keys, "audit_key", "left_semi").select("audit_key", "flag_id", "ord")
        last = stored.groupBy("audit_key").agg(F.max("ord").alias("_last"))
        new = new.join(stored, ["audit_key", "flag_id"], "left_anti").join(last, "audit_key", "left")
        # the values of one document
        place = F.row_number().over(Window.partitionBy("audit_key").orderBy("flag_id"))
        new = new.withColumn("ord", (F.coalesce("_last", F.lit(-1)) + place).cast("int"))
        evidence_of = F.when(F.col("source_id").isNotNull(), F.struct(F.col("source_id")))
        kinds = {f.name: f.dataType for f in self.table("flags").schema.fields}
        given = {"evidence": _widened(evidence_of, kinds["evidence"])} if "source_id" in new.columns else {}
        given |= {"verification_status": F.col("verdict")} if "verdict" in new.columns else {}
        self.append("flags", new.select(*(
            given.get(c, F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()
        )))

    # -- decisions -------------------------------------------------------------------
    def _log(self) -> DecisionLog:
        return DecisionLog(self.spark, f"{self.root}/decided")

    def submit_decisions(self, decisions: DataFrame) -> DataFrame:
        """A67. Log the acceptable decisions and bring their flags up to date; returns the
        rejected ones. A decision submitted again changes nothing."""
        accepted, rejected = D.split_decisions(decisions, self.table("audits"), self.table("flags"))
        self._log().add(accepted, self._log().next_batch())
        return rejected

    def _stored(self, name: str, audit_id: str | None) -> DataFrame:
        rows = self.table(name)
        return rows if audit_id is None else A.get_audit(rows, audit_id, strict=False)

    def current_flags(self, audit_id: str | None = None) -> DataFrame:
        """A63. Stored flags (of one audit) with the states the decisions left them in."""
        flags, states = self._stored("flags", audit_id), self._log().states(audit_id)
        if states is None:
            return flags.withColumns({
                "decision_count": F.lit(0).cast("bigint"), "decided_at": F.lit(None).cast("timestamp"),
            })
        return D.merge_decisions(flags, states)

    def current_audits(self, audit_id: str | None = None) -> DataFrame:
        """A43. Stored audits (or one); those with decisions rescored."""
        stored = self._stored("audits", audit_id)
        rescored = rescore_decided(stored, self.current_flags(audit_id))
        untouched = stored.join(rescored.select("audit_id"), "audit_id", "left_anti")
        return untouched.unionByName(rescored.select(*untouched.columns))

    def decision_history(self) -> DataFrame:
        """A64."""
        log = self._log().decisions()
        return D.decision_history(self.table("decisions") if log is None else log)

    # -- passports -------------------------------------------------------------------
    def passport(self, audit_ids: DataFrame) -> DataFrame:
        """A53."""
        return evidence.get_passport(audit_ids, self.table("passports"))

    def verify(self, requests: DataFrame) -> DataFrame:
        """A70."""
        return passports.verify_passports(requests, self.table("passports"))
