"""Column functions: text assembly, tokens, vectors, model outputs, answers."""
