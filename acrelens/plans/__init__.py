"""The registered queries: stand-in tables, Spark plans and the SQL that they are held against."""
