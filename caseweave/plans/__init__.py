"""Queries over the test tables: each operator on a log built from them, with the SQL that answers the same question."""
