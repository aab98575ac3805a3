"""Column expressions over note texts."""
