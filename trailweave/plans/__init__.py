"""Views that chain operators in a fixed order."""
