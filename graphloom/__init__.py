"""Code-intelligence analytics as DataFrame operators."""
