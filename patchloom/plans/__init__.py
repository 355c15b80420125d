"""Plans made of the operators: the batch run, generated cases, and the registered queries."""
