"""Column functions: text, paths, boxes, arrays, scores and seeded draws."""
