"""All registered queries."""

from mnemoscope.plans import (  # noqa: F401
    archive_queries, bundle_queries, generate_queries, job_queries, ledger_queries, matching_queries, metric_queries,
    rule_queries, source_queries, streaming_queries)
from mnemoscope.plans.catalog import ORACLES, QUERIES  # noqa: F401
