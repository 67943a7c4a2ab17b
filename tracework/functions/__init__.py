"""Column functions: higher-order array expressions and seeded uniforms."""
