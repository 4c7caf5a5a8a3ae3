"""Query operators over turns, runs and label verdicts."""
