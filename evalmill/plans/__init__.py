"""Views over the given tables, registered queries with their SQL twins, and composed jobs."""
