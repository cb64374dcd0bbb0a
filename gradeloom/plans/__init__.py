"""YAML plans and the operator registry."""
