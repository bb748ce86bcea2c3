"""Repair of file links by ordered rewrite rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]

# Folders of the manifest this was written for (regular expressions).
MOVED_FOLDER = r"(?i)MS Clinical trial Study[\\]UpdatedSearch16thAug[\\]ISIEmbase Update References"
MOVED_RULES: tuple[Rule, ...] = (
    ("MS Clinical trial Study", "Publications"),
    ("UpdatedSearch16thAug", "MS Clinical Trial"),
    ("ISIEmbase Update References", "Journals"),
    (r"\\Pre8thSeptember", ""),
    (r"\\New Folder", ""),
)
REMOVED_FOLDERS: tuple[str, ...] = (
    r"\\Multiple Sclerosis",
    r"\\Motor Neuron Disease",
    r"\\Huntington[']s Disease",
    r"\\Parkinson[']s Disease",
    r"\\Journals\\Alzheimers disease",
)


def keep_extension(df: DataFrame, column: str = "hlink", pattern: str = ".pdf$") -> DataFrame:
    """Links that end in the pattern, in any case; its dot stands for any character."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}"))


def rewrite_when(link: Column, condition: str, rules: Sequence[Rule]) -> Column:
    """Ordered replacements, only for links that match ``condition`` as they came in."""
    changed = link
    for pattern, replacement in rules:
        changed = F.regexp_replace(changed, pattern, replacement)
    return F.when(link.rlike(condition), changed).otherwise(link)


def remove_folders(link: Column, folders: Sequence[str]) -> Column:
    for folder in folders:
        link = F.regexp_replace(link, folder, "")
    return link


def canonical_root(link: Column, drive: str, share: str, base: str) -> Column:
    """``share`` at the start becomes ``drive``; links still without it get ``base`` in front.

    ``drive`` and ``share`` are literal and match in any case. Each step reads the link once: with
    conditions that repeat it, the generated code of a chain of rules grows beyond what the JVM takes.
    """
    other = f"(?i)^(?!{re.escape(drive)})"
    mounted = F.regexp_replace(link, F.lit(other + re.escape(share)), F.lit(_literal(drive)))
    return F.regexp_replace(mounted, F.lit(other), F.lit(_literal(base)))


def _literal(text: str) -> str:
    """A replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def text_link(link: Column, pattern: str = ".pdf$", extension: str = ".txt", strict: bool = False) -> Column:
    """Link of the extracted text. ``strict`` rewrites the lower-case extension only."""
    return F.regexp_replace(link, pattern if strict else f"(?i){pattern}", extension)


def normalize_links(
    df: DataFrame,
    column: str = "hlink",
    extension: str = ".pdf$",
    condition: str = MOVED_FOLDER,
    rules: Sequence[Rule] = MOVED_RULES,
    folders: Sequence[str] = REMOVED_FOLDERS,
    drive: str = "S:",
    share: str = r"\\server\share",
    base: str = "S:\\",
    text_extension: str = ".txt",
    strict: bool = False,
) -> DataFrame:
    """Keeps links with the extension, repairs them and adds ``txtlink``."""
    kept = keep_extension(df.filter(F.length(column) > 0), column, extension)
    link = remove_folders(rewrite_when(F.col(column), condition, rules), folders)
    repaired = kept.withColumn(column, canonical_root(link, drive, share, base))
    return repaired.withColumn("txtlink", text_link(F.col(column), extension, text_extension, strict))
