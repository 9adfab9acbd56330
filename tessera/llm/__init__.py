"""Training-data preparation at corpus scale: dedup, decontamination, scans, packing, output.

Nothing else in the library imports this subpackage.
"""
