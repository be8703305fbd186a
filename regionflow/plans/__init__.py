"""The operators applied to the driver tables, and the SQL they are checked with."""
