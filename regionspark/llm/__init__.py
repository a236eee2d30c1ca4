"""Operators for preparing training corpora; nothing else in regionspark imports this subpackage."""
