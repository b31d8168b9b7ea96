"""Declarative specs and the composed analyses built from the operators."""
