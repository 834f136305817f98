"""The registered queries, the tables they read, and the SQL they are checked against."""
