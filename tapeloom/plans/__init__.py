"""Expression language: text to tree to staged DataFrame plan."""
