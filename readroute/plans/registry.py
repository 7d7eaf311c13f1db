"""All queries outside the llm subpackage, and their SQL."""

from readroute.plans import files, problems, reads, reads_sql

QUERIES = {**problems.QUERIES, **reads.QUERIES, **files.QUERIES}
ORACLES = {**problems.ORACLES, **reads_sql.ORACLES, **files.ORACLES}
