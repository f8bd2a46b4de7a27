"""Dependency-ordered analysis of source code, and the tables it needs, on Spark."""
