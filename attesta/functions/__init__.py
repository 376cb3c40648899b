"""Column expressions without side effects; built-ins only unless the module says otherwise."""
