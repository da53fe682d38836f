"""Queries over the test tables, by family; each module has QUERIES and ORACLE_SQL."""
