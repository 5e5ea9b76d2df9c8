"""Bounds on what Python workers hold, by the name the operators here know them."""

from lodestone.memory import BATCH_BYTES, BATCH_ROWS, bounded, returned  # noqa: F401
