"""Package of the chunkloom engine."""
