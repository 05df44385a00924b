"""Column builders: node ids, labels and text, urls."""
