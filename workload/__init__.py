"""The operators applied to the given tables, with oracle SQL for each."""

from importlib import import_module, util

MODULES = ("relational", "indicators", "checks", "files", "corpus", "retrieval", "answers", "evaluation")


def load() -> None:
    """Register every query."""
    for name in MODULES:
        if util.find_spec(f"workload.{name}"):
            import_module(f"workload.{name}")
