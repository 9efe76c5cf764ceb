"""The operators on the test tables, with DuckDB SQL for the same results."""
