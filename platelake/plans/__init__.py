"""Registered queries over the supplied tables."""


def load_all() -> None:
    """Import every module that registers queries."""
    from platelake.plans import q_features, q_jobs, q_metrics, q_questions, q_tables  # noqa: F401
