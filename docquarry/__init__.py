"""Part of the docquarry engine."""
