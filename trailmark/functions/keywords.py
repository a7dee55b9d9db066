"""Keywords of folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords, and names that devices give.
STOP_WORDS = (
    "dcim", "canon", "apple", "camera", "photo", "image", "dsc", "img",
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with",
    "my", "our", "new", "old", "misc", "untitled", "folder", "pictures", "photos",
)
DEVICE_NAMES = r"^(dcim|img|dsc|pano|mvimg|vid|mov|gopr|screenshot)$"


def folder_keywords(folder: Column, extra_stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of 3 and more ASCII letters, in order, without stop words and device names; null folder: none."""
    stop = F.array(*[F.lit(w.lower()) for w in (*STOP_WORDS, *extra_stop_words)])
    words = F.array_distinct(F.transform(F.split(F.coalesce(folder, F.lit("")), "[^A-Za-z]+"), F.lower))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike(DEVICE_NAMES))
