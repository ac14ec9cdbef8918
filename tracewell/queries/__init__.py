"""Every operator as a runnable query over the test tables, with its SQL twin where SQL can say it."""

from tracewell.queries import registry
from tracewell.queries import (  # noqa: F401
    dataset,
    evaluation,
    functions,
    joins,
    selection,
    signal,
    sources,
    statistics,
    streams,
    triggers,
)

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
