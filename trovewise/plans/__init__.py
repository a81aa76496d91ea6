"""Plans made of operators: the choice of a strategy, timing, the registered queries."""
