"""Building blocks of the plans: indices, guards, constraint flags."""
