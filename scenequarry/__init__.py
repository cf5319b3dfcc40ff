"""Scene-annotation analytics on Spark: DataFrame operators over image-text annotation tables."""
