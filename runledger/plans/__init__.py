"""The registered queries and their DuckDB SQL."""
