"""Operators over facts, edges, constraints and anchors."""
