"""Registered queries over the driver's tables, with independent SQL."""


def load() -> tuple[dict, dict]:
    """All queries, and the SQL of those that SQL can express."""
    from tidemark.plans import eval_queries, evidence_queries, model_queries, more_queries, panel_queries, registry, rules_queries, source_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
