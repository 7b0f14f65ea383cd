"""The operators run on the given tables: wide fixtures, one query per key, and SQL to check them."""
