"""Named queries: each applies an operator to the driver's tables, with equivalent DuckDB SQL where SQL can say it."""
