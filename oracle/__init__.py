"""DuckDB SQL that states each query's expected result independently."""
