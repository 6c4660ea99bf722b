"""Column functions: markup, code languages, urls and links."""
