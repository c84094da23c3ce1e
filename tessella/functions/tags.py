"""Slide metadata text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TIFF's photometric codes (fixed values of the format).
PHOTOMETRIC = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "RGB", 3: "Palette", 4: "TransparencyMask", 5: "CMYK", 6: "YCbCr", 8: "CIELab"}
#: Chroma subsampling by its two spellings, with horizontal and vertical factors.
CHROMA = {"4:4:4": (1, 1), "444": (1, 1), "4:2:2": (2, 1), "422": (2, 1), "4:2:0": (2, 2), "420": (2, 2)}


def classify_ifd(description: Column | str, tiled: Column) -> Column:
    """Label and macro images by their descriptions, then pyramid levels by their tiles, else thumbnails."""
    text = F.lower(F.col(description) if isinstance(description, str) else description)
    return F.when(text.contains("label"), "Label").when(text.contains("macro"), "Macro").when(tiled, "PyramidLevel").otherwise("Thumbnail")


def described(description: Column | str, name: str, kind: str) -> Column:
    """The last `name = value` of a |-separated description as a number; null where there is none or that one is no number."""
    text = F.col(description) if isinstance(description, str) else description
    fields = F.transform(F.split(text, r"\|"), lambda x: F.trim(x))
    last = F.element_at(F.filter(fields, lambda x: x.startswith(f"{name} = ")), -1)
    return F.when(F.exists(fields, lambda x: x.startswith(f"{name} = ")), F.substring(last, len(name) + 4, 1 << 30).try_cast(kind))


def photometric(code: Column | str) -> Column:
    pairs = [F.lit(x) for item in PHOTOMETRIC.items() for x in item]
    return F.create_map(*pairs)[F.col(code) if isinstance(code, str) else code]


def chroma_factors(text: Column | str) -> Column:
    """struct(horizontal, vertical) of a subsampling's name; null for an unknown name."""
    known = F.trim(F.col(text) if isinstance(text, str) else text)
    out = F.lit(None).cast("struct<horizontal:int,vertical:int>")
    for name, (h, v) in CHROMA.items():
        out = F.when(known == name, F.struct(F.lit(h).alias("horizontal"), F.lit(v).alias("vertical"))).otherwise(out)
    return out


def stem(path: Column | str) -> Column:
    """A path's last part without its last extension; `slide` where nothing is left."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    name = F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when((name == "") | name.isin(".", ".."), "slide").otherwise(name)
