"""DataFrame operators over observation panels."""
