"""Where inventories, listings, file content and reports come from, and where results go."""
