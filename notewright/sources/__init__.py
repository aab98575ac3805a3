"""Where notes come from."""
