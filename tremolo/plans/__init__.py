"""Plans of work: what is to be made, and what is left of it."""
