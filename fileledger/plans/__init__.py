"""Plans: what would be moved, restored or deleted, as tables. Nothing here touches a file."""
