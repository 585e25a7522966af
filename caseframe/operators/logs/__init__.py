"""Log files to records, records to dated events."""
