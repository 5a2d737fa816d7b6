"""Plans that Catalyst has no operator for: closures over edge tables."""
