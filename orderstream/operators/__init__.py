"""DataFrame to DataFrame steps. None of them runs an action, reads a clock or collects rows."""
