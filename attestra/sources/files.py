"""Files as bytes: images, archives and HTML pages, checked and unpacked in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes, signatures and limits of uploads.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png"]
SIGNATURES = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF"}
MOST_IMAGE_BYTES, MOST_MANIFEST_BYTES, MOST_ARCHIVE_BYTES, MOST_ITEMS = 10 << 20, 1 << 20, 250 << 20, 400
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def images(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Images under a folder: path, bytes, length, modification time."""
    glob = "*.{" + ",".join([*suffixes, *[s.upper() for s in suffixes]]) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def upload_name_problem(name: Column, suffixes: list[str] = IMAGE_SUFFIXES) -> Column:
    """Why a file's name is refused, null if it is fine."""
    listed = "|".join(suffixes)
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "empty")
        .when(name.contains("..") | name.startswith("/"), "traversal")
        .when(name.rlike(r"[/\\]"), "separator")
        .when(~F.lower(name).rlike(rf"\.({listed})$"), "suffix")
        .when(F.lower(name).rlike(r"\.[a-z0-9]{1,5}\.[a-z0-9]+$"), "double extension")
    )


def signature_fits(name: Column, content: Column) -> Column:
    """Do the first bytes belong to what the suffix says?"""
    suffix, start = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.hex(F.substring(content, 1, 16))
    out = F.lit(False)
    for s, mark in SIGNATURES.items():
        out = out | ((suffix == s) & start.startswith(mark))
    return out


# How a page begins, and what it holds near its beginning, that was sent in place of an image.
PAGE_STARTS, PAGE_MARKS, PAGE_BYTES = ["<!doctype html", "<html"], ["<title>ttb online", "unable to render attachment"], 512


def looks_like_html(content: Column) -> Column:
    start = F.lower(F.substring(F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 4 * PAGE_BYTES), "ISO-8859-1"), r"^\s+", "")), 1, PAGE_BYTES))
    return reduce(lambda a, b: a | b, [start.startswith(x) for x in PAGE_STARTS] + [start.contains(x) for x in PAGE_MARKS])


def image_problem(name: Column, content: Column, most: int = MOST_IMAGE_BYTES) -> Column:
    return F.when(F.length(content) == 0, "empty").when(F.length(content) > most, "size").when(looks_like_html(content), "html").when(~signature_fits(name, content), "signature")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files decoded by the charset that their first 2,048 bytes declare, else UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"path": df["path"], "html": [decoded(c) for c in df["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, html string")


def decoded(content: bytes) -> str:
    found = _CHARSET.search(content[:2048])
    try:
        return content.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def archive_members(spark: SparkSession, path: str, member: str = r".*\.csv$", most: int = MOST_ARCHIVE_BYTES, members: int = MOST_ITEMS) -> DataFrame:
    """Files inside ZIP archives whose name fits; ``problem`` where an archive breaks a limit or cannot be read."""
    fits = re.compile(member, re.I)

    def rows(where: str, content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = [i for i in z.infolist() if not i.is_dir() and fits.match(i.filename)]
                if len(found) > members:
                    return [(where, None, None, "members")]
                if sum(i.file_size for i in found) > most:
                    return [(where, None, None, "size")]
                return [(where, i.filename, z.read(i), None) for i in found]
        except zipfile.BadZipFile:
            return [(where, None, None, "not a zip file")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for where, content in zip(df["path"], df["content"], strict=True):
                yield pd.DataFrame(rows(where, content), columns=["archive", "name", "content", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary, problem string")
