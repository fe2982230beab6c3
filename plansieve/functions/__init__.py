"""Column functions: colours, texts and geometry."""
