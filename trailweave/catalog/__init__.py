"""Named queries over the test tables, with the SQL they are checked against."""

from trailweave.catalog import conformance, discovery, explore, filters, relations, scalars, sources, space, streams, views

MODULES = [sources, streams, filters, scalars, discovery, explore, relations, space, conformance, views]


def all_queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
