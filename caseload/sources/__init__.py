"""Sources of the review-analytics engine."""
