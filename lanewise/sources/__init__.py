"""Readers for the source tables and the writer of the published marts."""
