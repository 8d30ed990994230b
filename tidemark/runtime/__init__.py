"""Driver-side control: configuration, offsets, state of a migration, HTTP."""
