"""Binary vector files, result files and saved indexes."""
