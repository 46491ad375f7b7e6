"""Reading and writing: typed CSV, spreadsheets, JSON envelopes, configuration, reports."""
