"""Jobs that chain the operators from log to result tables."""
