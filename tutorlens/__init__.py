"""Analytics for tutoring logs on PySpark: DataFrame queries over event, conversation and label tables."""
