"""Reviewer decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import audit_key, mapped, or_default, truthy
from veridraft.functions.texts import non_blank
from veridraft.operators.ordered import GROUP_ROWS, position, time_chunks
from veridraft.operators.scoring import rescore_decided

AUDIT_MISSING = "Audit not found"
FLAG_MISSING = "Flag not found"


def join_flags(decisions: DataFrame, flags: DataFrame) -> DataFrame:
    """A50. Decisions with their flag: audit id in any case, flag id exact."""
    keyed = flags.withColumn("_k", audit_key(F.col("audit_id"))).drop("audit_id")
    return decisions.withColumn("_k", audit_key(F.col("audit_id"))).join(keyed, ["_k", "flag_id"]).drop("_k")


def split_decisions(
    decisions: DataFrame, audits: DataFrame, flags: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A65. (accepted, rejected with ``reason``); every decision is in exactly one.

    The audit is looked up first: a flag whose audit is unknown does not count. Judged once
    per (audit, flag) pair of the decisions; flags and audits only meet those pairs.
    """
    keyed = decisions.withColumn("_k", audit_key(F.col("audit_id")))
    pairs = keyed.select("_k", "flag_id").distinct()
    asked = pairs.select("_k").distinct()
    audit_keys = (
        audits.select(audit_key(F.col("audit_id")).alias("_k")).join(asked, "_k", "left_semi").distinct()
        .withColumn("_audit", F.lit(True))
    )
    flag_keys = flags.select(audit_key(F.col("audit_id")).alias("_k"), "flag_id")
    known = flag_keys.join(pairs, ["_k", "flag_id"], "left_semi").distinct().withColumn("_flag", F.lit(True))
    refused = (
        pairs.join(audit_keys, "_k", "left").join(known, ["_k", "flag_id"], "left")
        .where("_audit IS NULL OR _flag IS NULL")
        .select("_k", "flag_id", F.when(F.col("_audit"), FLAG_MISSING).otherwise(AUDIT_MISSING).alias("reason"))
    )
    accepted = keyed.join(refused, ["_k", "flag_id"], "left_anti").select(*decisions.columns)
    rejected = keyed.join(refused, ["_k", "flag_id"]).select(*decisions.columns, "reason")
    return accepted, rejected


def flag_states(decisions: DataFrame) -> DataFrame:
    """A63. One row per flag with what its decisions come to, in a form that can be merged.

    Status follows the last *known* action. Notes follow the last DISMISS (its note, even
    if missing) or FIX (its note, or a default text). Aggregates, so a flag decided very
    often is reduced before the shuffle.
    """
    action = F.col("action")
    note = F.when(action == "FIX", or_default(F.col("note"), D.DEFAULT_FIX_NOTE)).otherwise(F.col("note"))
    at = [F.col("ts").alias("ts"), F.col("decision_id").alias("id")]
    return decisions.groupBy(audit_key(F.col("audit_id")).alias("_k"), "flag_id").agg(
        F.max(F.when(
            action.isin(*D.ACTION_STATUS), F.struct(*at, mapped(action, D.ACTION_STATUS).alias("value"))
        )).alias("status_at"),
        F.max(F.when(action.isin("DISMISS", "FIX"), F.struct(*at, note.alias("value")))).alias("note_at"),
        F.max("ts").alias("decided_at"),
        F.count(F.lit(1)).alias("decision_count"),
    )


def merge_states(states: DataFrame, *more: Column) -> DataFrame:
    """States of disjoint sets of decisions become the states of all of them; ``more`` to aggregate."""
    return states.groupBy("_k", "flag_id").agg(
        F.max("status_at").alias("status_at"), F.max("note_at").alias("note_at"),
        F.max("decided_at").alias("decided_at"), F.sum("decision_count").alias("decision_count"), *more,
    )


def merge_decisions(flags: DataFrame, states: DataFrame) -> DataFrame:
    """Flags with the result of ``flag_states`` applied; adds decision_count and decided_at."""
    columns = flags.columns
    merged = flags.withColumn("_k", audit_key(F.col("audit_id"))).join(states, ["_k", "flag_id"], "left")
    return merged.withColumns({
        "status": F.coalesce("status_at.value", "status"),
        # a winning NULL note is not the same as no such decision
        "reviewer_note": F.when(F.col("note_at").isNotNull(), F.col("note_at.value")).otherwise(
            F.col("reviewer_note")
        ),
        "decision_count": F.coalesce("decision_count", F.lit(0).cast("bigint")),
    }).select(*columns, "decision_count", "decided_at")


def apply_decisions(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """A63. Flags after all decisions; decisions on unknown flags change nothing."""
    return merge_decisions(flags, flag_states(decisions))


def decision_history(decisions: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A64. The log with the 1-based ``step`` of each entry on its flag; raw notes.

    Ordered rows rather than one array per flag: a flag may be decided any number of times.
    """
    keyed = decisions.withColumn("_k", audit_key(F.col("audit_id")))
    return position(
        keyed, ["_k", "flag_id"], [F.col("ts"), F.col("decision_id")], time_chunks(), "step", group_rows
    ).drop("_k")


def validate_notes(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A66. (valid, invalid): a dismissal and an edit need a non-blank note.

    Edits are rows with ``action = 'FIX'`` and ``is_edit``; a plain fix needs no note.
    """
    edit = F.col("is_edit") if "is_edit" in decisions.columns else F.lit(False)
    needs = (F.col("action") == "DISMISS") | ((F.col("action") == "FIX") & edit)
    judged = decisions.withColumn("_ok", F.coalesce(~needs, F.lit(True)) | non_blank(F.col("note")))
    return judged.where("_ok").drop("_ok"), judged.where("NOT _ok").drop("_ok")


def first_deliveries(decisions: DataFrame) -> DataFrame:
    """Each ``decision_id`` once: the delivery with the earliest time, ties by the other columns.

    An aggregation, so an id that comes very often is reduced before the shuffle.
    """
    rest = [c for c in decisions.columns if c not in ("decision_id", "ts")]
    first = decisions.groupBy("decision_id").agg(F.min(F.struct("ts", *rest)).alias("_d"))
    return first.select(*(F.col(c) if c == "decision_id" else F.col(f"_d.{c}") for c in decisions.columns))


def process_decisions(audits: DataFrame, flags: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """A67. Reject, apply, log and rescore in one pass over the log.

    A decision that was delivered again (same ``decision_id``) counts once, as it was first
    made. A rejected decision changes nothing: neither does one on a flag whose audit is
    unknown. Only audits with an accepted decision are rescored; their decision counter grows
    by the number of accepted log rows. Returns audits, flags, history, rejected.
    """
    accepted, rejected = split_decisions(first_deliveries(decisions), audits, flags)
    current = apply_decisions(flags, accepted)
    return {
        "audits": rescore_decided(audits, current),
        "flags": current,
        "history": decision_history(accepted),
        "rejected": rejected,
    }


def candidate_edits(flags: DataFrame) -> DataFrame:
    """A69. Proposed replacement text per flag: the suggested fix, else the claim."""
    return flags.select(
        "audit_id", "flag_id",
        F.coalesce(truthy(F.col("suggested_fix")), truthy(F.col("claim")), F.lit("")).alias("candidate"),
    )


def edits_as_decisions(edits: DataFrame) -> DataFrame:
    """A69. Submitted edits become FIX decisions with the text as note.

    edits(decision_id, audit_id, flag_id, text, reviewed_by, ts). The text is not checked
    again against the sources.
    """
    return edits.where(non_blank(F.col("text"))).select(
        "decision_id", "audit_id", "flag_id", F.lit("FIX").alias("action"),
        F.col("text").alias("note"), "reviewed_by", "ts",
    )
