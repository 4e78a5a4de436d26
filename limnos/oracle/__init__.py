"""Independent DuckDB SQL for every S-checkable query (the correctness oracle)."""
