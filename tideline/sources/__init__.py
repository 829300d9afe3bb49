"""Sample tables, the metric catalog, request inputs and result outputs."""
