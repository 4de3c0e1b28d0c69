"""Part of tallyfield; see the README."""
