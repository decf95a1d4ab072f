"""DataFrame -> DataFrame operators: joins, aggregates, models and reports."""
