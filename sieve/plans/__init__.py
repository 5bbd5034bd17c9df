"""Plans made of operators: scoring, training with threshold selection, and the evaluation report."""
