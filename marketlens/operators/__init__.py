"""Business metrics: every function takes a warehouse and parameters, returns a DataFrame."""
