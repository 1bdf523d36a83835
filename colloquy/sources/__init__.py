"""Reading transcripts: scans, format detection and one importer a format."""
