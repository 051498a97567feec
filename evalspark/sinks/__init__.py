"""Writers of result tables and files."""
