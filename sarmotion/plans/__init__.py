"""End-to-end commands and the table-backed query catalogue."""
