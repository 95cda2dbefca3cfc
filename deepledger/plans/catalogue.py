"""All queries over the survey tables, with their SQL."""

from deepledger.plans import location_queries, model_queries, picture_queries, report_queries, store_queries, survey_queries

MODULES = (survey_queries, location_queries, model_queries, picture_queries, report_queries, store_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
