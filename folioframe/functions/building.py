"""New files: page sizes and blank documents."""

from __future__ import annotations

from folioframe.functions.cos import Name, Ref
from folioframe.functions.writing import write_file

# Page sizes in points.
PAGE_SIZES = {"letter": (612.0, 792.0), "legal": (612.0, 1008.0), "a3": (842.0, 1191.0), "a4": (595.0, 842.0), "a5": (420.0, 595.0)}


def blank_file(size: str | tuple[float, float] = "a4", pages: int = 1, version: str = "1.7") -> bytes:
    """A file of blank pages of a named size, or of a width and height in points."""
    width, height = PAGE_SIZES[size.lower()] if isinstance(size, str) else size
    if pages < 0 or width <= 0 or height <= 0:
        raise ValueError("sizes must be positive")
    kids = [Ref(3 + i, 0) for i in range(pages)]
    objects = {k: {"Type": Name("Page"), "Parent": Ref(2, 0), "Resources": {}} for k in kids}
    objects[Ref(1, 0)] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    objects[Ref(2, 0)] = {"Type": Name("Pages"), "Kids": kids, "Count": pages, "MediaBox": [0, 0, width, height]}
    return write_file(objects, {"Root": Ref(1, 0)}, version)
