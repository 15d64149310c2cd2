"""Plans that span operators, and session helpers."""
