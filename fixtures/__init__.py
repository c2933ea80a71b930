"""Test inputs derived from the given tables, and the SQL to check results with."""
