"""Packing rows into archives on the executors: the inverse of expansion, for round trips."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import re
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "name string, size long, mtime_ns long, content binary"


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tar_bytes(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, data in members:
            x = tarfile.TarInfo(name)
            x.size, x.mtime = len(data), 981173106
            t.addfile(x, io.BytesIO(data))
    return out.getvalue()


def nested_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """tgz -> tar -> zip -> members."""
    return gzip.compress(tar_bytes([("inner/archive.zip", zip_bytes(members))]), 1)


PACKERS: dict[str, Callable[[list[tuple[str, bytes]]], bytes]] = {"zip": zip_bytes, "tar": tar_bytes, "tgz": nested_bytes}
STREAMS: dict[str, Callable[[bytes], bytes]] = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}


def pack(rows: DataFrame, volume: Column, member: Column, content: Column, fmt: str) -> DataFrame:
    """(name, size, mtime_ns, content): one archive `volume.fmt` per volume.

    A volume must be small enough to be packed in one task: derive it from row numbers or
    ids, not from a key that can hold any number of rows.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        data = PACKERS[fmt](sorted((n, bytes(c)) for n, c in zip(g["member"], g["content"])))
        return pd.DataFrame({"name": [f"{g['volume'].iloc[0]}.{fmt}"], "size": [len(data)], "mtime_ns": [10**18], "content": [data]})

    r = rows.select(volume.cast("string").alias("volume"), member.alias("member"), content.cast("binary").alias("content"))
    return r.groupBy("volume").applyInPandas(one, FILES)


def squeeze(rows: DataFrame, name: Column, content: Column, fmt: str) -> DataFrame:
    """(name, size, mtime_ns, content): each row as a compressed file of its own."""

    def run(batches):
        for b in batches:
            data = [STREAMS[fmt](bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"name": b["name"] + "." + fmt, "size": [len(d) for d in data], "mtime_ns": 10**18, "content": data})

    return rows.select(name.alias("name"), content.cast("binary").alias("content")).mapInPandas(run, FILES)


def pack_forms(rows: DataFrame, volume: Column, member: Column, content: Column, forms: list[tuple[str, Callable[[list[tuple[str, bytes]]], bytes]]]) -> DataFrame:
    """(name, size, mtime_ns, content): one archive per volume number, in one of the forms
    (a name with {} for the number, and what makes the bytes) by turns."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        number = int(g["volume"].iloc[0])
        name, build = forms[number % len(forms)]
        data = build(sorted((n, bytes(c)) for n, c in zip(g["member"], g["content"])))
        return pd.DataFrame({"name": [name.format(number)], "size": [len(data)], "mtime_ns": [10**18], "content": [data]})

    r = rows.select(volume.cast("long").alias("volume"), member.alias("member"), F.coalesce(content, F.lit("")).cast("binary").alias("content"))
    return r.groupBy("volume").applyInPandas(one, FILES)


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) as files below a folder that executors and driver have mounted;
    the number of files.  A file appears whole, so a task that is repeated does no harm."""
    folder = re.sub("^file:/*", "/", folder)

    def run(batches):
        for b in batches:
            for name, data in zip(b["name"], b["content"]):
                full = os.path.join(folder, name)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{os.getpid()}.tmp"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, full)
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
