"""Gates, duplicate control, cleaning, response parsing and tracking tables."""
