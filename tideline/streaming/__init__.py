"""No streaming operators: every analysis reads a whole table of sightings.

The row-wise steps (typed reading, label repair, filters, subarea rules) are
plain column expressions, so they also apply to a streaming DataFrame as they are.
"""
