"""Where a pair of texts goes: extension, tier and route as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY, RAW, PROSE, MARKUP, DATA, CODE = range(6)

#: Extensions of each tier.
BINARY_EXTENSIONS = "png jpg jpeg gif webp bmp ico mp3 wav flac ogg mp4 mov webm exe dll so dylib bin wasm o a pdf zip tar gz 7z bz2 xz ttf otf woff woff2 eot".split()
DATA_EXTENSIONS = "json jsonc json5 yaml yml toml ini cfg".split()
MARKUP_EXTENSIONS = "html htm xml svg xaml plist".split()
RAW_EXTENSIONS = "md mdx rst adoc org csv tsv graphql dockerfile".split()
PROSE_EXTENSIONS = "txt log".split()
PROSE_NAMES = "license readme changelog authors".split()
CODE_EXTENSIONS = "rs c cpp h hpp go java kt py rb php swift cs js mjs cjs ts jsx tsx scala lua sh sql bash zsh fish css scss less vue svelte astro".split()


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; the whole path if it has none."""
    return F.lower(F.substring_index(path, ".", -1))


def is_binary_extension(ext: Column) -> Column:
    """The extension is one of binary formats."""
    return F.lower(ext).isin(BINARY_EXTENSIONS)


def tier(path: Column) -> Column:
    """0 binary, 1 raw, 2 prose, 3 markup, 4 data, 5 code; null for a null path."""
    groups = ((BINARY, BINARY_EXTENSIONS), (DATA, [*DATA_EXTENSIONS, "env"]), (MARKUP, MARKUP_EXTENSIONS), (RAW, RAW_EXTENSIONS), (PROSE, PROSE_EXTENSIONS), (CODE, CODE_EXTENSIONS))
    known = F.create_map(*[F.lit(x) for kind, names in groups for e in names for x in (e, kind)])
    low = F.lower(path)
    # Names that end in one of these count unless an earlier group has the extension.
    found = F.try_element_at(known, F.substring_index(low, ".", -1))
    named = F.when(_any([low.endswith(x) for x in (".env", ".env.local")]), DATA).when(_any([low.endswith(x) for x in PROSE_NAMES]), PROSE).otherwise(RAW)
    late = F.when((found == CODE) & _any([low.endswith(x) for x in PROSE_NAMES]), PROSE).otherwise(found)
    return F.when(path.isNotNull(), F.coalesce(late, named)).cast("tinyint")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def is_parseable(path: Column) -> Column:
    """A tree can be made of the file: data, markup, or code that some parser knows."""
    from ..adapters.code import LANGUAGE_OF

    kind = tier(path)
    return kind.isin(DATA, MARKUP) | ((kind == CODE) & extension(path).isin(sorted(LANGUAGE_OF)))


def looks_binary(source: Column) -> Column:
    """A NUL among the first 8,192 characters, or a replacement character anywhere."""
    return F.contains(F.substring(source, 1, 8192), F.lit("\x00")) | F.contains(source, F.lit("�"))


def route(old_path: Column, old_source: Column, new_source: Column) -> Column:
    """same, insert, delete, binary, prose, markup, data, code or raw; a null source counts as empty."""
    old, new = F.coalesce(old_source, F.lit("")), F.coalesce(new_source, F.lit(""))
    kind = tier(old_path)
    return (
        F.when((old == "") & (new != ""), "insert")
        .when((new == "") & (old != ""), "delete")
        .when(old == new, "same")
        .when((kind == BINARY) | ((kind == RAW) & (looks_binary(old) | looks_binary(new))), "binary")
        .when(kind == PROSE, "prose")
        .when(kind == MARKUP, "markup")
        .when(kind == DATA, "data")
        .when(kind == CODE, "code")
        .otherwise("raw")
    )


def reported_path(old_path: Column, new_path: Column, old_source: Column, new_source: Column) -> Column:
    """The new path of an added file, else the old one."""
    added = (F.coalesce(old_source, F.lit("")) == "") & (F.coalesce(new_source, F.lit("")) != "")
    return F.when(added, new_path).otherwise(old_path)
