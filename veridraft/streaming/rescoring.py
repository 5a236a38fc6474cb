"""Live rescoring from a stream of reviewer decisions.

Every micro-batch adds to two tables of levelled runs (see ``runs``): the log of raw decisions
and the states of the flags it decided. A state holds the winning decisions with their (time,
id), and states of different decisions can be merged in any order, so a decision may arrive at
any time: it wins exactly if it is the newest, as in the batch pipeline. Nothing is dropped for
being late, and nothing is kept in a state store.

A batch reads of the log what lies in the buckets of its audits, to know decisions that come
again, and of the states nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridraft.functions.columns import audit_key
from veridraft.operators.decisions import first_deliveries, flag_states, merge_decisions, merge_states
from veridraft.operators.scoring import rescore_decided
from veridraft.streaming.runs import BUCKETS, FAN, Runs


def _merged_log(rows: DataFrame) -> DataFrame:
    return first_deliveries(rows.drop("run_first"))


def _merged_states(rows: DataFrame) -> DataFrame:
    """One state per flag. A state that is marked ``whole`` replaces those of earlier runs."""
    flag = Window.partitionBy("_k", "flag_id")  # one row per run
    since = F.coalesce(F.max(F.when(F.col("whole"), F.col("run_first"))).over(flag), F.lit(-1))
    return merge_states(rows.withColumn("_since", since).where("run_first >= _since"), F.bool_or("whole").alias("whole"))


class DecisionLog:
    """Decisions and flag states below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Runs(spark, f"{self.root}/log", ["_k"], _merged_log, buckets, fan)
        self.runs = Runs(spark, f"{self.root}/states", ["_k"], _merged_states, buckets, fan)

    def next_batch(self) -> int:
        return self.log.next_batch()

    def known(self, buckets: list[int], before: int | None = None) -> DataFrame | None:
        """The log of some buckets, each decision as first delivered."""
        rows = self.log.read(before, buckets)
        return None if rows is None else _merged_log(rows)

    def add(self, decisions: DataFrame, batch_id: int) -> None:
        """Log the decisions that are new, and the states of the flags they decide.

        A decision that comes again changes nothing, unless its time is earlier than the one
        known; then its flag's state is made anew from the log.
        """
        if not self.log.merged_away(batch_id):  # else both runs of this batch were written before
            self._add(decisions, batch_id)
        self.log.merge_due(batch_id)
        self.runs.merge_due(batch_id)

    def _add(self, decisions: DataFrame, batch_id: int) -> None:
        batch = first_deliveries(decisions.withColumn("_k", audit_key(F.col("audit_id"))))
        known = self.known(self.log.buckets_of(batch), batch_id)
        if known is not None:
            before = known.select("decision_id", F.col("ts").alias("_ts"))
            batch = batch.join(before, "decision_id", "left").where("_ts IS NULL OR ts < _ts").drop("_ts")
        self.log.put(batch, batch_id)
        new = self.log.only(batch_id)
        new = decisions.limit(0).withColumn("_k", F.lit("")) if new is None else new
        if known is None:
            self.runs.put(flag_states(new).withColumn("whole", F.lit(False)), batch_id)
            return
        moved = new.join(known, "decision_id", "left_semi").select("_k", "flag_id").distinct()
        plain = flag_states(new.join(moved, ["_k", "flag_id"], "left_anti"))
        every = first_deliveries(known.unionByName(new))
        anew = flag_states(every.join(moved, ["_k", "flag_id"], "left_semi"))
        self.runs.put(
            plain.withColumn("whole", F.lit(False)).unionByName(anew.withColumn("whole", F.lit(True))), batch_id
        )

    def decisions(self) -> DataFrame | None:
        """Every decision once."""
        log = self.log.current()
        return None if log is None else log.drop("_k")

    def states(self, audit_id: str | None = None) -> DataFrame | None:
        """The state of every decided flag, or of those of one audit: then its bucket alone is read."""
        if audit_id is None:
            found = self.runs.current()
            return None if found is None else found.drop("whole")
        key = audit_key(F.lit(audit_id))
        found = self.runs.read(buckets=self.runs.buckets_of(self.spark.range(1).select(key.alias("_k"))))
        return None if found is None else _merged_states(found.where(F.col("_k") == key)).drop("whole")

    def compact(self) -> None:
        """One run each; to be called between batches."""
        self.log.compact()
        self.runs.compact()


def start_rescoring(decisions: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the stream into a ``DecisionLog`` at ``root``: every decision takes effect once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # a batch is read for its buckets and for its rows
        try:
            DecisionLog(batch.sparkSession, root).add(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        decisions.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .foreachBatch(add)
        .start()
    )


def live_scores(audits: DataFrame, flags: DataFrame, states: DataFrame) -> DataFrame:
    """Audits with at least one decision, rescored from the flags' states."""
    return rescore_decided(audits, merge_decisions(flags, states))
