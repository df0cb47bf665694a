"""Views over the tables, and the queries with the SQL each must equal."""
