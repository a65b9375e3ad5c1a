"""PySpark-native analytics for question banks, assessments and text corpora."""
