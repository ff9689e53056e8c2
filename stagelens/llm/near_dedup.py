"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum, so half as
many hash evaluations are needed as with minima alone, and the two are an unbiased estimate of lower variance.
Bands of the signature put documents in buckets. A bucket's members are checked on their full shingle sets against
the bucket's most connected member, its lead. Where that leaves different classes beside a lead, what two members
share is at most what each shares with the lead, and the shingles outside the lead that both have; only pairs for
which that bound allows a link are checked. No pairs of one class are ever listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, stored, tidy, utf8
from .graphs import components, dealt_join, salted_join
from .shingles import mix, shingle_sets

WORDS = 5
#: Links have PERCENT hundredths of the union in common at least, unless a caller says otherwise.
PERCENT = 85
#: A link at the threshold shares no band, and is missed, with this probability at most.
MISSED = 2e-6

_U = np.uint64


@dataclass(frozen=True)
class Level:
    """What follows from the least similarity of a link, in hundredths: bands and values a band, and conditions."""

    percent: int

    @property
    def rows(self) -> int:
        return 6 if self.percent >= 85 else 5

    @property
    def bands(self) -> int:
        """An even number of values in all, as a permutation gives two."""
        many = ceil(log(MISSED) / log(1 - (self.percent / 100) ** self.rows))
        return many + many * self.rows % 2

    @property
    def share(self) -> float:
        """A link of x and y means that both have this times (size of x + size of y) shingles at least."""
        return self.percent / (self.percent + 100) - 1e-9

    @property
    def similar(self) -> str:
        return f"100 * d >= {self.percent} * (na + nb - d)"

    @property
    def sizes(self) -> str:
        return f"100 * least(n_x, n_y) >= {self.percent} * greatest(n_x, n_y)"


@cache
def _factors(many: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, many, dtype=np.uint64) * _U(2) + _U(1)


@cache
def _places(many: int) -> np.ndarray:
    return np.random.default_rng(978).integers(1, 2**63, many, dtype=np.uint64) * _U(2) + _U(1)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """Rows of `values` values, two a permutation: the minimum and the maximum of each permutation, side by side."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), values), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k, factor in enumerate(_factors(values // 2)):
            x = every * factor
            x ^= x >> _U(31)
            out[full, 2 * k] = np.minimum.reduceat(x, starts)
            out[full, 2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def _digest(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _signed(level: Level) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    bands, size = level.bands, level.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch["text"])
            for a, b in blocks(offsets):
                sets = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], WORDS)
                values = mix((signatures(sets, bands * size).reshape(len(sets), bands, size) * _places(size)).sum(axis=2, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(map(_digest, sets), pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, values.size + 1, bands, dtype=np.int32), values.ravel()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch["text"])
        for a, b in blocks(offsets):
            sets = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], WORDS)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(map(_digest, sets), pa.binary()), grams], names=["doc", "digest", "grams"])


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets and of what both have. AQE splits a side with one common
    document."""
    first = sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga"))
    second = sets.select(F.col("doc").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("d"))


def _sides(rows: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """The rows as first and as second member of a pair, the first of another class than the lead's."""
    names = ("doc", "n", "d", "class")
    x = rows.where("class <> main").select("lead", *also, *(F.col(c).alias(f"{c}_x") for c in names))
    return x, rows.select("lead", *also, *(F.col(c).alias(f"{c}_y") for c in names), "main")


_ONCE = "class_x <> class_y and (class_y = main or doc_x < doc_y)"


def _pairs_within_lead(member: DataFrame, level: Level, total: int) -> DataFrame:
    """Pairs whose shares of the lead alone allow a link. As the first isn't linked with the lead, the second must
    be smaller than the lead; few are."""
    x, y = _sides(member.where(f"d >= {level.share} * (n + least) and (class <> main or n < nb)"), "many")
    pairs = dealt_join(x, y, ["lead"], "doc_x", "many", total)
    return pairs.where(f"{_ONCE} and {level.sizes} and least(d_x, d_y) >= {level.share} * (n_x + n_y)").select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b"))


def _pairs_beyond_lead(member: DataFrame, leads: DataFrame, sets: DataFrame, level: Level, total: int) -> DataFrame:
    """Pairs that have shingles outside the lead in common, as many as a link needs beside their shares of it."""
    own = sets.select("doc", F.col("grams").alias("mine"))
    its = sets.select(F.col("doc").alias("lead"), F.col("grams").alias("its")).join(leads.select("lead", "many"), "lead")
    extra = salted_join(member.drop("many").join(own, "doc"), its, ["lead"], "doc", "many", total)
    extra = extra.select("lead", "doc", "n", "d", "class", "main", F.explode(F.array_except("mine", "its")).alias("gram"))
    extra = stored(extra, "extra")
    every = extra.count()
    live = extra.groupBy("lead", "gram").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("have")).where("low <> high").select("lead", "gram", "have")
    x, y = _sides(salted_join(extra, live, ["lead", "gram"], "doc", "have"), "gram", "have")
    pairs = dealt_join(x, y, ["lead", "gram"], "doc_x", "have", every).where(f"{_ONCE} and {level.sizes}")
    pairs = pairs.groupBy("lead", "doc_x", "doc_y").agg(F.count("*").alias("k"), *(F.min(c).alias(c) for c in ("n_x", "n_y")), *(F.max(c).alias(c) for c in ("d_x", "d_y")))
    return pairs.where(f"least(d_x, d_y) + k >= {level.share} * (n_x + n_y)").select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b"))


def _of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a doc_id's different texts; few ids have several."""
    ids = signed.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    several = signed.join(stored(ids.select("doc_id"), "ids"), "doc_id").select("doc_id", "digest").join(classes.select("digest", "doc"), "digest")
    first = several.groupBy("doc_id").agg(F.min("doc").alias("b"))
    return several.join(first, "doc_id").where("doc <> b").select(F.col("doc").alias("a"), "b")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is their component's, with their columns as they are. Rows without shingles
    stay, as do all rows of a doc_id that is kept, and rows with a null id."""
    gone = near_duplicates(docs, doc_id, text, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = stored(gone, "gone")
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked that have percent hundredths of the union of their shingles in common at least.
    n_shingles is the number of distinct five-word shingles (the whole sequence is one where there are fewer
    words, none without words); component_id the smallest doc_id that links reach; kept tells whether it is the
    row's own. Null and empty texts, and texts of white space, have no shingles and are linked with nothing.
    Equal sets are one class, however many there are. Rows that repeat a doc_id with one text all stay kept if
    that id is its component's; a doc_id with several texts is one document that has
    the links of each of them, so pairs of an id are compared by each pair of their texts. A null doc_id links with nothing
    and is kept. Extra columns aren't read. A task holds a single text whole, with about 20 bytes a byte of it.
    """
    level = Level(percent)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(own.mapInArrow(tidy(_signed(level)), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")

    # Equal sets: one representative, the smallest doc_id.
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = stored(classes.agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("doc", F.posexplode("bands").alias("band", "value"))
    buckets = entries.groupBy("band", "value").agg(F.count("*").alias("many")).where("many > 1")
    many = level.bands * classes.count()
    entries = stored(salted_join(entries, buckets, ["band", "value"], "doc", "many", many), "entries")

    # Full sets of the documents that share a bucket. A bucket's lead is the member with the most company.
    asked = entries.groupBy("doc").agg(F.sum("many").alias("reach"))
    # Documents in buckets grow with the corpus, so they are merged with the texts at every size, and sent nowhere.
    sets = own.join(asked.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(tidy(_sets), "doc long, digest binary, grams array<long>")
    sets = stored(sets.groupBy("doc", "digest").agg(F.first("grams").alias("grams")).drop("digest"), "sets")
    lead = entries.join(asked, "doc").groupBy("band", "value").agg(F.max(F.struct("reach", (-F.col("doc")).alias("minus"))).alias("best"), F.count("*").alias("members"))
    lead = lead.select("band", "value", (-F.col("best.minus")).alias("lead"), "members")
    pairs = salted_join(entries.drop("many"), lead, ["band", "value"], "doc", "members", entries.count()).where("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")).distinct()
    checked = stored(_shared(pairs, sets), "checked")
    known = stored(components(checked.where(level.similar).select("a", "b").unionByName(_of_one_id(signed, classes))), "known")

    # Members of other classes than their lead's, against members of other classes than their own.
    of = lambda node, name: known.select(F.col("node").alias(node), F.col("component").alias(name))
    member = checked.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    member = member.select(F.col("b").alias("lead"), "nb", F.col("a").alias("doc"), F.col("na").alias("n"), "d", F.coalesce("ca", "a").alias("class"), F.coalesce("cb", "b").alias("main"))
    leads = member.groupBy("lead").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.count_if(F.expr("class <> main")).alias("apart"))
    leads = stored(leads.where("apart > 0").drop("apart"), "leads")
    # A lead's row is copied to each part of its members, which keep `many` and `least`.
    member = stored(salted_join(member, leads, ["lead"], "doc", "many"), "member")
    total = member.count()
    rest = _pairs_within_lead(member, level, total).unionByName(_pairs_beyond_lead(member, leads, sets, level, total)).distinct()
    more = _shared(stored(rest, "rest"), sets).where(level.similar).select("a", "b")
    every = more.unionByName(known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = components(every)

    # Back to every row, by its digest; only classes of several rows or with links are looked up.
    named = classes.join(found, F.col("doc") == F.col("node"), "left").where("last <> doc or component is not null")
    named = stored(named.select("digest", F.coalesce("component", "doc").alias("component")), "named")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
