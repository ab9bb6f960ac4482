"""Frame operators: scoring stages, clustering, star schema, audits, KPIs, report metrics."""
