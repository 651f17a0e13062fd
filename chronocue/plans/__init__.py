"""Parsers of replies and reports: text to rows, by line explode and section fill."""
