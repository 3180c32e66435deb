"""Session, table and plan helpers that every other module builds on."""
