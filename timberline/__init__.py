"""Log search on Spark: lines in Parquet, templates mined from them, boolean text queries as filters."""
