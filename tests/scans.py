"""What an executed plan has read and moved."""

from __future__ import annotations


def nodes(node):
    """All operators of an executed plan, stages included."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(node.plan())
    else:
        yield kind, node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))


def _sum(df, kind: str, metric: str) -> int:
    found = [n.metrics().get(metric) for k, n in nodes(df._jdf.queryExecution().executedPlan()) if k == kind]
    return sum(m.get().value() for m in found if m.isDefined())


def scanned(df) -> dict[str, int]:
    """Run a plan; the files and rows that its scans have read."""
    df.collect()
    return {"files": _sum(df, "FileSourceScanExec", "numFiles"), "rows": _sum(df, "FileSourceScanExec", "numOutputRows")}


def shuffled_bytes(df) -> int:
    """Run a plan; the bytes of the rows its exchanges have passed on."""
    df.collect()
    return _sum(df, "ShuffleExchangeExec", "dataSize")
