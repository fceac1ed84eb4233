"""Queries by area, each with the SQL that must give the same rows."""
