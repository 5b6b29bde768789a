"""Point-in-time analytics over large panels."""
