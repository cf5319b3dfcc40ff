"""DataFrame operators on annotation tables."""
