"""DataFrame operators over series, features, scores and run logs."""
