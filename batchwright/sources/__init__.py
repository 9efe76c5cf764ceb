"""Tables and validators: where rows come from and where they go."""
