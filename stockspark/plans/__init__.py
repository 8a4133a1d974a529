"""Parameters, the query catalog and the export registry."""
