"""Clients of services outside: one transport, and models and embedders on top of it."""
