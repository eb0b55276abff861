"""mediaquarry: a PySpark-native analytics engine for media catalogs and text corpora."""
