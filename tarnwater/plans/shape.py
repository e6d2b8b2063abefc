"""A label for the shape of a plan: what its main query block does with the rows of all partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _spine(plan) -> Iterator:
    """The nodes from the root down to the first that joins or unites several; subqueries in expressions are not on it."""
    while True:
        yield plan
        children = plan.children()
        if children.size() != 1:
            return
        plan = children.apply(0)


def plan_shape(df: DataFrame) -> str:
    """WITH_CTE_MERGE, NESTED_GROUP_BY_MERGE, GROUP_BY_MERGE, PARTIAL_AGG, TOP_K or CONCATENATE."""
    nodes = [(node.nodeName(), node) for node in _spine(df._jdf.queryExecution().analyzed())]
    names = [name for name, _ in nodes]
    aggregates = [node for name, node in nodes if name == "Aggregate"]
    if "WithCTE" in names or "CTERelationRef" in names:
        return "WITH_CTE_MERGE"
    if len(aggregates) > 1:
        return "NESTED_GROUP_BY_MERGE"
    if aggregates:
        return "GROUP_BY_MERGE" if aggregates[0].groupingExpressions().size() else "PARTIAL_AGG"
    return "TOP_K" if {"Sort", "GlobalLimit"} & set(names) else "CONCATENATE"
