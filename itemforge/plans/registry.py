"""All registered queries on the driver's tables, and their SQL."""

from itemforge.plans import bank_queries, enrichment_queries, extraction_queries, quiz_queries, report_queries, review_queries, scoring_queries, source_queries, stream_queries

MODULES = (scoring_queries, bank_queries, quiz_queries, extraction_queries, review_queries, enrichment_queries, report_queries, source_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.query.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.query.oracles.items()}
