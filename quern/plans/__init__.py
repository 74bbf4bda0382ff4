"""Driver-side plans: which item runs when."""
