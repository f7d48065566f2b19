"""Zip packages as part rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scan_packages(files: DataFrame, key: str = "pkg") -> DataFrame:
    """One row per part: name, extension, size, UTF-8 text and CRC result.

    A file that is no zip package gives one row with ``error``.
    """
    kind = files.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "part", "ext", "bytes", "text", "crc_ok", "error"]
        for batch in batches:
            for pkg, content in zip(batch[key], batch["content"]):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for info in z.infolist():
                            if info.filename.endswith("/"):
                                continue
                            ext = info.filename.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in info.filename else ""
                            try:
                                data, good = z.read(info), True
                            except zipfile.BadZipFile:
                                data, good = b"", False
                            try:
                                text = data.decode("utf-8")
                            except UnicodeDecodeError:
                                text = None
                            out.append((pkg, info.filename, ext, info.file_size, text, good, None))
                except zipfile.BadZipFile:
                    out.append((pkg, None, None, None, None, None, "not a zip package"))
                frame = pd.DataFrame(out, columns=names)
                frame["bytes"] = frame["bytes"].astype("Int64")
                yield frame

    return files.select(key, "content").mapInPandas(
        scan, f"{key} {kind}, part string, ext string, bytes bigint, text string, crc_ok boolean, error string")


def build_packages(parts: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """A zip package per row; ``columns`` maps part names to text columns."""
    kind = parts.schema[key].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.to_dict("records"):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, column in columns.items():
                        z.writestr(name, row[column])
                made.append(held.getvalue())
            yield pd.DataFrame({key: batch[key], "content": made})

    return parts.select(key, *columns.values()).mapInPandas(build, f"{key} {kind}, content binary")
