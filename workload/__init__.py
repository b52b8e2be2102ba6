"""Driver tables in the roles of the raw loan tables, queries over them, and their SQL."""
