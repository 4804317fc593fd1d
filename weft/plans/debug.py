"""Switches for notes on standard error: names in WEFT_DEBUG, parted by commas.

grip-filtration: sizes of a multilevel layout's layers.  grip-timing: seconds
of its stages.  knn-profile: counters of nearest-vertex searches.
"""

from __future__ import annotations

import os
import sys

NAMES = ("grip-filtration", "grip-timing", "knn-profile")


def on(name: str) -> bool:
    if name not in NAMES:
        raise ValueError(f"no switch {name}")
    return name in os.environ.get("WEFT_DEBUG", "").split(",")


def say(name: str, text: str) -> None:
    if on(name):
        print(f"{name}: {text}", file=sys.stderr)
