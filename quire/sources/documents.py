"""Files as pages: a directory scan with one row per file, and decoders behind a small interface.

Decoding PDF, recognising scans and calling models need libraries that aren't part of this package. A decoder is any object
with ``name`` and ``pages(path, content)``; register it and it runs within ``mapInPandas``. The built-in one reads plain text, with
form feeds between pages. A file that can't be decoded gives a row with its error, never a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "document_id string, source_filename string, page_number int, width double, height double, text string, error string"


class Decoder(Protocol):
    name: str

    def pages(self, path: str, content: bytes) -> list[tuple[float, float, str]]:
        """(width, height, text) of each page."""


class PlainText:
    name = "plain_text"

    def pages(self, path: str, content: bytes) -> list[tuple[float, float, str]]:
        return [(612.0, 792.0, t) for t in content.decode("utf-8").split("\f")]


class Missing:
    """Stands for a decoder whose library isn't there."""

    def __init__(self, name: str) -> None:
        self.name = name

    def pages(self, path: str, content: bytes) -> list[tuple[float, float, str]]:
        raise RuntimeError(f"plugin not installed: {self.name}")


DECODERS: dict[str, Decoder] = {"plain_text": PlainText(), **{n: Missing(n) for n in ("fast_text", "layout_aware", "ocr_heavy", "vision_augmented")}}


def register(decoder: Decoder) -> None:
    DECODERS[decoder.name] = decoder


def document_id(stem: str | Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the file's stem."""
    return F.substring(F.sha2(stem, 256), 1, 12)


def scan(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime, content) of each file; pattern and column choice reach the source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def decode(files: DataFrame, decoder: str = "plain_text", pages: list[int] | None = None) -> DataFrame:
    """The pages of files from ``scan``. pages: only these, 1-based; None or an empty list means all."""
    d, wanted = DECODERS[decoder], set(pages or [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f.path, f.content):
                name = PurePosixPath(path).name
                key = hashlib.sha256(PurePosixPath(path).stem.encode()).hexdigest()[:12]
                try:
                    found = [(key, name, i, w, h, t, None) for i, (w, h, t) in enumerate(d.pages(path, content), 1) if not wanted or i in wanted]
                except Exception as e:  # noqa: BLE001  one bad file must not end the others
                    found = [(key, name, None, None, None, None, f"{type(e).__name__}: {e}")]
                out += found
            g = pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])
            g["page_number"] = g["page_number"].astype("Int32")
            yield g

    return files.select("path", "content").mapInPandas(run, PAGES)


def ledger(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """A ledger of JSON lines, whole or of one document."""
    schema = "document_id string, chunk_id string, action string, event_time timestamp, metadata_json string"
    x = spark.read.schema(schema).json(path)
    return x if document_id is None else x.where(F.col("document_id") == document_id)
