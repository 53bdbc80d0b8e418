"""Clusterers. Each gives (id, label) rows; labels never depend on row positions."""
