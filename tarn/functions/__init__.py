"""Column functions: paths, patterns, dates, durations, text and lists."""
