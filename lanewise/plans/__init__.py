"""Compositions of operators: the table bundle, the published marts, the dashboard."""
