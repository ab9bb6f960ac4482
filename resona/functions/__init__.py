"""Column functions: every one maps columns to a column and never shuffles."""
