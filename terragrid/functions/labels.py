"""String keys and labels as expressions. Nulls stay null unless the function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name prefix -> area.
AREA_PREFIXES = {"unita": "unita", "lluta": "lluta", "chugchug": "chugchug", "chug": "chugchug", "granllama": "granllama", "salvador": "salvador"}
# Class code -> name.
CLASS_NAMES = {1: "geo", 2: "ground", 3: "road"}


def area_of_file(name: Column, prefixes: dict[str, str] = AREA_PREFIXES) -> Column:
    """The area that a file name starts with (`<prefix>_`, any case), else `unknown`; null counts as unknown."""
    out = F.lit("unknown")
    for p, area in reversed(prefixes.items()):
        out = F.when(F.lower(name).startswith(f"{p}_"), area).otherwise(out)
    return out


def numbered(prefix: Column, number: Column, suffix: str = "", digits: int = 4) -> Column:
    """prefix_0042suffix."""
    return F.concat(prefix, F.lit("_"), F.format_string(f"%0{digits}d", number), F.lit(suffix))


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def metadata_key(path: Column, kind: str = "_ortho") -> Column:
    """What an image and its metadata have in common: the stem without `kind`."""
    return F.replace(stem(path), F.lit(kind), F.lit(""))


def class_name(code: Column, names: dict[int, str] = CLASS_NAMES) -> Column:
    out = F.lit("unknown")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def stride_of(text: Column) -> Column:
    """struct<x, y> of `64` or `64x32`; null for anything else."""
    part = F.split(F.lower(F.trim(text)), "x")
    ok = F.trim(text).rlike(r"^(?i)\d+(x\d+)?$")
    return F.when(ok, F.struct(F.get(part, F.lit(0)).cast("int").alias("x"), F.element_at(part, -1).cast("int").alias("y")))


def config_label(window: Column, stride: Column, noise: Column, level: Column) -> Column:
    return F.concat(F.lit("w"), window, F.lit("_s"), stride, F.lit("_"), noise, F.lit("_"), level)


def title(text: Column) -> Column:
    """`lbp_entropy` -> `Lbp Entropy`."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def info_card(fields: dict[str, Column]) -> Column:
    """A small HTML table of named values; nulls show as `?`."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("?")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<table>"), *[F.concat(F.lit(f"<tr><th>{k}</th><td>"), safe(c), F.lit("</td></tr>")) for k, c in fields.items()], F.lit("</table>"))
