"""Column functions and the few Arrow functions that SQL cannot express."""
