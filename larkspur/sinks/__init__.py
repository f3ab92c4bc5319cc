"""Where results go: previews, diagnostics, JSON lines and reports."""
