"""Registered queries: each pairs a Spark job with the SQL that states its expected result."""
