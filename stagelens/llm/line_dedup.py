"""Repeated passages by hashing the units of lines: of equal units the earliest stays, later ones go, with their
offsets kept.

A unit is a stretch of a line that ends at the first sentence end after LEAST words or more, or at the line's end. Any
sentence of that many words ends a unit, wherever the unit began, so a passage inside a line falls into the same
units in every document that has it, but for what stands around its two ends; and a short sentence ("Yes.") goes with
the sentence after it instead of being a unit, which would repeat everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored
from .graphs import salted_join

#: Words from which a sentence end closes a unit.
LEAST = 5

# White space inside lines, and a unit's words; a word that ends with one of .!? ends a sentence.
_WHITE = r"[\t\x0b\x0c\r ]"
_WORD = r"[^\t\x0b\x0c\r \n]++"
_UNIT = re.compile(rf"{_WORD}(?:{_WHITE}++{_WORD}){{{LEAST - 1},}}?(?<=[.!?])|{_WORD}(?:{_WHITE}++{_WORD})*+")
_RUN = re.compile(rf"{_WHITE}+")


def spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of each unit, in code points."""
    return [m.span() for m in _UNIT.finditer(text)]


def normalised(unit: str) -> str:
    """Lower case, with each run of white space as one space."""
    return _RUN.sub(" ", unit.lower())


_UNITS = "doc_id long, version long, place int, start int, end int, words int, high long, low long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in _UNITS.split(", ")], [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
    for batch in batches:
        for doc, version, text in zip(*(batch[c] for c in ("doc_id", "version", "text")), strict=True):
            if not (text := text.as_py()):
                continue
            found = spans(text)
            if not found:
                continue
            plain = [normalised(text[a:b]) for a, b in found]
            digests = b"".join(hashlib.blake2b(p.encode(), digest_size=16).digest() for p in plain)
            halves = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, pa.py_buffer(digests)])
            many = len(found)
            begin, end = zip(*found, strict=True)
            columns = [pa.repeat(doc, many), pa.repeat(version, many), range(many), begin, end, [p.count(" ") + 1 for p in plain], halves[::2], halves[1::2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types, strict=True)], names=names)


def without(text: str, gone: set[int]) -> str:
    """The text without the units that begin at the offsets. A line that loses units keeps the others as they are,
    with one space between them; one that loses all goes with its line end."""
    out, at = [], 0
    for line in text.split("\n"):
        found = [(at + a, at + b) for a, b in spans(line)]
        kept = [text[a:b] for a, b in found if a not in gone]
        if len(kept) == len(found):
            out.append(line)
        elif kept:
            out.append(" ".join(kept))
        at += len(line) + 1
    return "\n".join(out)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_units, n_removed, removed, text, words_removed, longest_removed) for each row of docs.

    Units are equal if they are in lower case and with runs of white space as one space. Of equal units the one with
    the smallest (doc_id, place) is kept, of different texts with one doc_id and place the one with the smallest hash
    of the text; every later one goes, however short. removed lists start:end of the units that went, in code points
    of the original text; text is what is left, null where it was null. words_removed counts their words, and
    longest_removed those of the longest stretch of neighbouring ones: a passage that repeats, not a greeting.
    Null texts and texts of white space have no units. Rows that repeat a doc_id and its text count as one
    occurrence. Rows with a null id neither keep nor lose units. Other columns aren't read. A single text is held
    whole by its task, with about 150 bytes a unit beside it.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    units = stored(own.where("doc_id is not null").mapInArrow(_units, _UNITS), "units")
    place, digest, row = F.struct("doc_id", "place", "version"), ["high", "low"], ["doc_id", "version"]
    first = units.groupBy(*digest).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select(*digest, "first", "n"), "first")
    later = salted_join(units, first, digest, "doc_id", "n").where(F.col("first") != place).select(*row, "place", "start", "end", "words").distinct()
    later = later.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*row).orderBy("place")))
    runs = later.groupBy(*row, "run").agg(F.sum("words").alias("words"), F.collect_list(F.struct("start", "end")).alias("gone"))
    gone = runs.groupBy(*row).agg(F.array_sort(F.flatten(F.collect_list("gone"))).alias("gone"), F.sum("words").alias("words_removed"), F.max("words").alias("longest_removed"))
    rows = own.join(stored(gone, "gone"), row, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts, gone = part["text"].to_pylist(), [x or [] for x in part["gone"].to_pylist()]
                columns = {
                    "doc_id": part["doc_id"],
                    "n_units": pa.array([len(spans(t or "")) for t in texts], pa.int64()),
                    "n_removed": pa.array(map(len, gone), pa.int64()),
                    "removed": pa.array([",".join(f"{s['start']}:{s['end']}" for s in g) for g in gone], pa.string()),
                    "text": pa.array([without(t, {s["start"] for s in g}) if g else t for t, g in zip(texts, gone, strict=True)], pa.string()),
                    "words_removed": part["words_removed"].fill_null(0),
                    "longest_removed": part["longest_removed"].fill_null(0),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.select("doc_id", "text", "gone", "words_removed", "longest_removed").mapInArrow(run, "doc_id long, n_units long, n_removed long, removed string, text string, words_removed long, longest_removed long")
