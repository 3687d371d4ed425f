"""Where facts, texts and code come from."""
