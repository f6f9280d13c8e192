"""Where elements, Markdown and state tables come from."""
