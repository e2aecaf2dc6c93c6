"""Part of millrace; see the modules."""
