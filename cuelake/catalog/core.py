"""Named queries of the core and their SQL twins."""

from __future__ import annotations

from cuelake.catalog import scalars, work
from cuelake.plans import timeline_gaps

QUERIES = {"p4_found": timeline_gaps.p4_found, **scalars.QUERIES, **work.QUERIES}
SQL = {"p4_found": timeline_gaps.P4_FOUND_SQL, **scalars.SQL, **work.SQL}
