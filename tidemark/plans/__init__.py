"""Compositions of operators: the reference's end-to-end flows and the query catalog."""
