"""The methods end to end, composed from the operators."""
