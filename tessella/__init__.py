"""tessella: a PySpark-native relational algebra, query set and analytics toolkit."""
