"""Operators over terrain, sites, devices and links."""
