"""The catalogue of queries, each with the SQL that gives the same rows where there is one."""
