"""End-to-end compositions of operators (the reference's entry points)."""
