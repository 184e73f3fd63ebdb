"""All queries of the engine and the SQL that states them."""

from . import cut_model, model_queries, queries, report_queries, shape_model, step_model

QUERIES = queries.QUERIES | step_model.QUERIES | shape_model.QUERIES | report_queries.QUERIES | cut_model.QUERIES | model_queries.QUERIES
SQL = queries.SQL | step_model.SQL | shape_model.SQL | report_queries.SQL | cut_model.SQL | model_queries.SQL
