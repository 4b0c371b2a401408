"""What a query's plan did when it ran: rows by kind of node."""

from __future__ import annotations


def nodes(frame) -> list:
    """All nodes of the plan of a frame on which an action has run, with those behind stages."""
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        found.append(node)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


def most_rows(frame, *kinds: str) -> int:
    """The most rows that a node gave whose name has one of ``kinds``; ``frame`` is collected first."""
    frame.collect()
    own = [n.metrics() for n in nodes(frame) if any(k in n.nodeName() for k in kinds)]
    names = ("numOutputRows", "shuffleRecordsWritten")
    return max((m.apply(x).value() for m in own for x in names if m.contains(x)), default=0)
