"""DataFrame -> DataFrame operators (joins, sampling, model, scoring, reports)."""
