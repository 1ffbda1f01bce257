"""tonelake: analytics over content-addressed collections, written as plain PySpark."""
