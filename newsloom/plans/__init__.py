"""Plan plumbing shared by all operators: tables, shared storage, skew handling."""
