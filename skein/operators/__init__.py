"""Operators over tables of pages and documents."""
