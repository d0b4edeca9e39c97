"""A semantic analytics engine for Spark: declared models, semantic queries, and DataFrame plans."""
