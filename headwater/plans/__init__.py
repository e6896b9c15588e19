"""Release planning, merging, data-quality and operations reports."""
