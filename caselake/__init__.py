"""Design analytics on Spark: cases of segments, their geometry, features, splits, models and reports."""
