"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index stores a posting (term, document, position) for each training word that occurs in a benchmark item. A
phrase's rarest terms select postings; a posting less the term's offset is a possible beginning, and beginnings on
which the two rarest lists agree are compared with the phrase word by word. Nothing is collected, and a side is
broadcast only by Spark's own check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .graphs import salted_join

#: Words of a window, and the share of hit words from which a document is contaminated.
WINDOW, SHARE = 13, 20
#: Lists that are intersected before a beginning is compared with its phrase.
LISTS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever isn't an ASCII letter or digit or beyond ASCII stands between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text column with A-Z lower-cased; empty for null."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.filter(parts, lambda w: w != "")


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(phrase, words, items): each different window of `size` words of the items, with the sorted ids of those that
    have it. An item of fewer words, but not none, is one window. Null texts have none; an item with a null id
    counts as hit words but is in no list of items."""
    rows = benchmark.select(F.col(item_id).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    rows = rows.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return rows.select(F.xxhash64(F.array_join("words", " ")).alias("phrase"), "words", "items")


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (term, doc, pos) of every word of docs that is among the different terms, positions from 0.
    Texts that are null have no postings; rows with a null id are kept under it."""
    every = docs.select(F.col(doc_id).alias("doc"), F.posexplode(words(text)).alias("pos", "term"))
    return every.join(terms.select("term"), "term")


def beginnings(docs: DataFrame, phrases: DataFrame, lists: int = LISTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, phrase, n, start): where the offset-adjusted lists of each phrase's `lists` rarest terms agree. phrases
    has (phrase, words). Terms are counted first, which combines before the shuffle, and only the rarest have their
    postings stored."""
    terms = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    wanted = stored(terms.select("term").distinct(), "terms")  # Spark's check of sizes sees how small it is
    counts = stored(postings(docs, wanted, doc_id, text).groupBy("term").agg(F.count("*").alias("df")), "counts")
    terms = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = terms.groupBy("phrase", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))), 1, lists).alias("rare"))
    rare = rare.where("rare[0].df > 0").select("phrase", "n", F.size("rare").alias("asked"), F.inline("rare"))
    # A row a term, with the phrases that ask for it: as many as the benchmark has, whatever the corpus.
    rare = stored(rare.groupBy("term").agg(F.first("df").alias("df"), F.collect_list(F.struct("phrase", "n", "offset", "asked")).alias("uses")), "rare")
    index = stored(postings(docs, rare, doc_id, text), "postings")
    found = salted_join(index, rare, ["term"], "doc", "df").select("doc", "pos", F.inline("uses"))
    found = found.select("doc", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start"), "asked").where("start >= 0")
    return found.groupBy("doc", "phrase", "n", "start").agg(F.count("*").alias("agree"), F.first("asked").alias("asked")).where("agree >= asked").select("doc", "phrase", "n", "start")


def proximity(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(doc, phrase, pos): occurrences of each phrase's rarest term that have all its other terms at most `within`
    positions away, in any order."""
    terms = phrases.select("phrase", F.explode(F.array_distinct("words")).alias("term"))
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    terms = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = terms.groupBy("phrase").agg(F.min(F.struct("df", "term")).alias("best"), F.count("*").alias("many")).where("best.df > 0")
    anchors = index.join(best.select("phrase", "many", F.col("best.term").alias("term")), "term").select("doc", "phrase", "many", F.col("pos").alias("at"))
    # A posting meets anchors of its own stretch of positions and of the two beside it, and no others.
    stretch = F.floor(F.col("at") / (within + 1))
    near = anchors.select("*", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    lists = index.join(terms.select("phrase", "term"), "term").select("doc", "phrase", "term", "pos", F.floor(F.col("pos") / (within + 1)).alias("stretch"))
    met = near.join(lists, ["doc", "phrase", "stretch"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    met = met.groupBy("doc", "phrase", "at").agg(F.countDistinct("term").alias("got"), F.first("many").alias("many"))
    return met.where("got = many").select("doc", "phrase", F.col("at").alias("pos"))


def _covered(spans: Column) -> Column:
    """Positions inside any of the spans (start, n)."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(so_far: Column, span: Column) -> Column:
        end = (span["start"] + span["n"]).cast("long")
        new = F.greatest(end - F.greatest(so_far["end"], span["start"].cast("long")), F.lit(0).cast("long"))
        return F.struct(F.greatest(so_far["end"], end).alias("end"), (so_far["sum"] + new).alias("sum"))

    return F.aggregate(F.array_sort(spans), start, add)["sum"]


def _hit_rows(docs: DataFrame, phrases: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, version, n_words, n_hit, phrases) for each row of docs; version is a hash of its text. What a row
    carries is bounded by its text: at each place one phrase of each length."""
    found = beginnings(docs, phrases, LISTS, doc_id, text).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "phrase")).alias("found"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Beginnings grow with the corpus, so they are merged with the texts at every size, and sent nowhere.
    own = own.join(stored(found, "found").hint("merge"), F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    own = own.select("doc_id", F.xxhash64("text").alias("version"), words("text").alias("w"), "found")
    true = F.filter("found", lambda x: F.xxhash64(F.array_join(F.slice(F.col("w"), x["start"] + 1, x["n"]), " ")) == x["phrase"])
    own = own.select("doc_id", "version", F.size("w").cast("long").alias("n_words"), F.coalesce(true, F.array().cast(_FOUND)).alias("found"))
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))
    return own.select("doc_id", "version", "n_words", _covered(spans).alias("n_hit"), F.array_distinct(F.transform("found", lambda x: x["phrase"])).alias("phrases"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    A word is hit if it is inside an occurrence of any window; items are those whose windows occur. Where the lists
    agree the document's words are compared with the phrase by their 64-bit hash. Null and empty texts, and an empty
    benchmark, give no hits; the digest is then of the empty string. Rows that repeat a doc_id are each compared with
    their own text; null ids match each other. Other columns aren't read. A text of any length is one array of words
    in its task.
    """
    phrases = stored(windows(benchmark), "windows")
    rows = stored(_hit_rows(docs, phrases, doc_id, text), "hit_rows")
    row = ["doc_id", "version"]
    uses = rows.where("size(phrases) > 0").select(*row, F.explode("phrases").alias("phrase")).distinct()
    asked = phrases.select("phrase", "items").join(uses.groupBy("phrase").agg(F.count("*").alias("many")), "phrase")
    items = salted_join(uses, stored(asked, "asked"), ["phrase"], "version", "many").select(*row, F.explode("items").alias("item")).distinct()
    items = items.groupBy(*row).agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = items.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.size("items").cast("long").alias("__n"), F.sha2(F.array_join("items", ","), 256).alias("__digest"))
    out = rows.drop("phrases").join(stored(items, "items"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("version") == F.col("__version")), "left")
    contaminated = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    n, digest = F.coalesce("__n", F.lit(0).cast("long")), F.coalesce("__digest", F.sha2(F.lit(""), 256))
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), digest.alias("items_sha256"), contaminated.alias("contaminated"))


_FOUND = "array<struct<start: int, n: int, phrase: bigint>>"


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without any window of the benchmark, with their columns as they are. A document goes for one
    window, however long it is: a share would let whole passages through in long documents. Rows that share a doc_id
    go together; rows with a null id stay unless one of them has a window."""
    rows = _hit_rows(docs, stored(windows(benchmark), "windows"), doc_id, text)
    bad = rows.where("n_hit > 0").select(F.col("doc_id").alias("__bad")).distinct()
    bad = stored(bad, "contaminated")  # its size is known then, and docs needn't be shuffled where it is small
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]), "left_anti")
