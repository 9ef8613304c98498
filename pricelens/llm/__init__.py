"""Training-data operators: secrets, main text, decontamination, quality, token counts,
licenses, toxicity, web archives, near copies and packing.

Nothing outside this folder (and the driver files that register it) imports it.
"""
