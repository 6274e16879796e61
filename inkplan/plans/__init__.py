"""Whole plans and the queries over the tables of a data directory."""
