"""Standard MIDI files: notes in seconds, by a parser of our own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import path_stem
from tessera.operators.sequences import with_pauses


def notes(data: bytes) -> list[tuple[float, float, int, int]]:
    """(start, end, pitch, track) of every note, tracks in file order; a malformed file raises ValueError."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise ValueError("no MIDI header")
    n_tracks, division = int.from_bytes(data[10:12]), int.from_bytes(data[12:14])
    if division & 0x8000 or not division:
        raise ValueError("frame-based or empty time division")
    at, tracks, tempi = 8 + int.from_bytes(data[4:8]), [], [(0, 500_000)]
    for _ in range(n_tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("no track where one should be")
        size = int.from_bytes(data[at + 4 : at + 8])
        tracks.append(_track(data[at + 8 : at + 8 + size], tempi))
        at += 8 + size
    tempi.sort(key=lambda x: x[0])

    def seconds(tick: int) -> float:
        total, before, tempo = 0.0, 0, 500_000
        for start, value in tempi:
            if start >= tick:
                break
            total += (start - before) * tempo / division / 1e6
            before, tempo = start, value
        return total + (tick - before) * tempo / division / 1e6

    return [(seconds(a), seconds(b), pitch, i) for i, track in enumerate(tracks) for a, b, pitch in track]


def _track(data: bytes, tempi: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    at = tick = status = 0
    open_: dict[tuple[int, int], list[int]] = {}
    found = []

    def number() -> int:
        nonlocal at
        value = 0
        while True:
            byte = data[at]
            at += 1
            value = value << 7 | byte & 0x7F
            if byte < 0x80:
                return value

    try:
        while at < len(data):
            tick += number()
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind = data[at]
                at += 1
                size = number()
                if kind == 0x51:
                    tempi.append((tick, int.from_bytes(data[at : at + 3])))
                at += size
                if kind == 0x2F:
                    break
            elif status in (0xF0, 0xF7):
                size = number()
                at += size
            elif status >> 4 in (0x8, 0x9):
                pitch, velocity = data[at], data[at + 1]
                at += 2
                own = (status & 0xF, pitch)
                if status >> 4 == 0x9 and velocity:
                    open_.setdefault(own, []).append(tick)
                elif open_.get(own):
                    found.append((open_[own].pop(0), tick, pitch))
            elif status >> 4 in (0xC, 0xD):
                at += 1
            elif status:
                at += 2
            else:
                raise ValueError("data before any status")
    except IndexError as e:
        raise ValueError("the track ends early") from e
    return sorted(found)


def scan(spark: SparkSession, folder: str, most_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, id, note_idx, start, end, pitch, track), (path, error)) of the *.mid files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid").load(folder)
    if most_files is not None:
        files = files.orderBy("path").limit(most_files)  # the file list is cut before any file is decoded

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    own = notes(content)
                    out += [(path, i, *n, None) for i, n in enumerate(own)] or [(path, None, None, None, None, None, "no notes")]
                except ValueError as e:
                    out.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "note_idx", "start", "end", "pitch", "track", "error"]).astype({"note_idx": "Int64", "pitch": "Int64", "track": "Int64"})

    rows = files.select("path", "content").mapInPandas(decode, "path string, note_idx long, start double, end double, pitch long, track long, error string")
    good = rows.where("error IS NULL").select("path", path_stem(F.col("path")).alias("id"), "note_idx", "start", "end", F.col("pitch").cast("int").alias("pitch"), "track")
    return good, rows.where("error IS NOT NULL").select("path", "error")


def sequences(found: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(id, pos, token): notes of all tracks by start, pauses between."""
    order = [F.col("start"), F.col("track"), F.col("note_idx")]
    return with_pauses(found, "id", order, F.col("start"), F.col("end"), F.col("pitch"), threshold)
