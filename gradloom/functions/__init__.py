"""Column functions: text preparation, answer extraction and grading, judge keys."""
