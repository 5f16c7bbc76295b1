"""Reading and writing: tables, exports, event frames, files."""
