"""The registered queries: one Spark query and, where SQL can state it, its SQL twin."""
import importlib

GROUPS = ["text", "predicates", "extract", "relations", "groups", "merges", "reasoning"]


def load():
    from caseweave.queries.registry import REGISTRY

    for g in GROUPS:
        importlib.import_module(f"caseweave.queries.{g}")
    return REGISTRY
