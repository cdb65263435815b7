"""Column builders: encoders of values as sets of bit positions, and scalar rules."""
