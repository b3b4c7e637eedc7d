"""Training-data operators: token files, fingerprints, revisit resolution, license
alignment, quality scoring, packing, deduplication, chat windows and byte-level BPE.

Nothing else in the library imports this subpackage.
"""
