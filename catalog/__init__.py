"""Registered queries over the test star schema, and their SQL counterparts."""
