"""From statements or JSON to the plan that the engine runs."""
