"""Column functions: text clean-up, Markdown, identifiers, dates and costs."""
