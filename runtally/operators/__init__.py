"""DataFrame operators over run history, task definitions and graphs."""
