"""Functions of the review-analytics engine."""
