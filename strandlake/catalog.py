"""All registered queries."""

from __future__ import annotations

from strandlake.functions import text  # noqa: F401  each module registers its queries
from strandlake.operators import alignment, calls, kmers, ml, nets, reads, sites, sources_lr, stats  # noqa: F401
from strandlake.plans import driver_queries  # noqa: F401
from strandlake.registry import ORACLE_SQL, QUERIES  # noqa: F401
