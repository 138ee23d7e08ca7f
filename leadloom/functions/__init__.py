"""Column -> Column building blocks: text, phones, leads, HTML, URLs, times."""
