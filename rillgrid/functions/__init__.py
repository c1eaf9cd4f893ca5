"""Column functions: no action, no shuffle, all inside code generation."""
