"""From source text to routes, services, entities, components and imports."""
