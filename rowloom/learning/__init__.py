"""Training, scoring and comparing models with MLlib."""
