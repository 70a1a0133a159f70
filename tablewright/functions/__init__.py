"""Reusable column expressions shared by operators (all JVM-side built-ins)."""
