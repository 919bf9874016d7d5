"""Column functions: text, units, sets of ids; all native but where stated."""
