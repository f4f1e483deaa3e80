"""Training-data operators: one module per operator, nothing outside imports them."""
