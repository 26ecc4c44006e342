"""Reading source datasets, storing target tables."""
