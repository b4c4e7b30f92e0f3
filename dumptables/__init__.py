"""Wiki dumps to tables and text corpora, on Spark.

Subpackages: ``sources`` reads dumps, ``functions`` holds column rules, ``operators`` DataFrame operators and sinks,
``plans`` whole conversions and the registered queries, ``streaming`` the same work on arriving files.
"""

from .plans.convert import (
    bad_pages,
    convert_current,
    convert_dump,
    convert_history,
    create_corpus,
    current_tables,
    good_revisions,
    history_tables,
    main_articles,
    stage_dump,
)
from .session import build_session
from .sources.dump import (
    dump_headers,
    explode_revisions,
    quarantine_malformed,
    quarantine_revisions,
    scan_dump,
    scan_headers,
    scan_namespaces,
)
from .sources.history import scan_history

__all__ = [
    "bad_pages", "build_session", "convert_current", "convert_dump", "convert_history", "create_corpus", "current_tables",
    "dump_headers", "explode_revisions", "good_revisions", "history_tables", "main_articles", "quarantine_malformed",
    "quarantine_revisions", "scan_dump", "scan_headers", "scan_history", "scan_namespaces", "stage_dump",
]
