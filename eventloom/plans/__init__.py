"""Plans made of several operators: recovery."""
