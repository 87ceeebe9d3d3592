"""Column builders: scalar rules, normalisers and geometry expressions."""
