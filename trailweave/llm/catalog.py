"""The named queries of this package, with their SQL where there is one."""

from importlib import import_module

MODULES = [import_module(f"trailweave.llm.{name}") for name in ("decontaminate", "exact", "jaccard", "language", "mixing", "perplexity", "personal", "phrases", "secrets", "simhash", "spelling", "tokens", "toxicity")]


def all_queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
