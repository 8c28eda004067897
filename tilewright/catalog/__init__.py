"""Queries over the driver's tables, one for each operator, with the DuckDB SQL that gives the same rows."""
