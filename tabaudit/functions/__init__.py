"""Column helpers and the statistics shared by the operators."""
