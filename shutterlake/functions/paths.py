"""Path columns: sidecars, owners, collision tokens, and keys of the render store."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EXTENSIONS = ("arw", "dng")
DEVELOP_VERSION = 7
TIERS = ("thumb", "browse", "full")


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    """Full case folding, then canonical decomposition, which no SQL function does."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFD", s.casefold()), na_action="ignore")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_raw_name(name: Column) -> Column:
    """Whether a file of this name is a photo: a known extension in any case, not hidden."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*RAW_EXTENSIONS) & ~name.startswith(".")


def sidecar_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", ".xmp")


def sidecar_owner(path: Column, folder_ignores_case: Column) -> Column:
    """The sidecar path that names a photo's owner, its name folded where the folder
    ignores case: ASCII names by ASCII lower-casing, others as collision tokens."""
    sidecar = sidecar_path(path)
    name, parent = file_name(sidecar), F.regexp_extract(sidecar, r"^(.*/)?", 0)
    folded = F.when(name.rlike(r"^\p{ASCII}*$"), F.lower(name)).otherwise(_folded(name))
    return F.when(folder_ignores_case, F.concat(parent, folded)).otherwise(sidecar)


def collision_token(path: Column) -> Column:
    """The stem, folded: names that could be one photo's on some file system share it.
    ASCII stems stay in the JVM."""
    s = stem(path)
    return F.when(s.rlike(r"^\p{ASCII}*$"), F.lower(s)).otherwise(_folded(s))


def cache_key(path: Column, size: Column, mtime_ns: Column, tier: Column, quality: Column) -> Column:
    """64 hex digits that change with the file, the develop version, the tier and the quality."""
    parts = [path, size.cast("string"), mtime_ns.cast("string"), F.lit(str(DEVELOP_VERSION)), tier, F.lit("jpeg-quality"), quality.cast("string")]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def object_path(key: Column) -> Column:
    """Shard and file of a key; null unless the key is 64 hex digits."""
    return F.when(key.rlike("^[0-9a-f]{64}$"), F.concat(F.substring(key, 1, 2), F.lit("/"), key, F.lit(".jpg")))
