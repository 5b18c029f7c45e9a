"""Audit-trail analytics for tool-call and JSON-RPC traffic, on Spark DataFrames."""
