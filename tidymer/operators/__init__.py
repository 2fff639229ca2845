"""Operators from DataFrame to DataFrame. Profiles are long: entity, feature, value."""
