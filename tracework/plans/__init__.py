"""Registered queries, with the DuckDB SQL that each is held against."""
