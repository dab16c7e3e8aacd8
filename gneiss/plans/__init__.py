"""Registered queries: Spark plans over a folder of Parquet tables, and the SQL they are compared with."""
