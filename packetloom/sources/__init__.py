"""Where packets come from: capture files and packet tables."""
