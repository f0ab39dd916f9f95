"""Plans of the review-analytics engine."""
