"""Audit of how far the sources of a language diverge in their words.

Words are counted for each language and source in one pass, with partial counts in each
task; each language keeps the terms that enough of its documents have.  Each source gives
each kept term a smoothed share in whole billionths, and two sources differ by the sum
over all kept terms of ``f(p, q) = (p - q) ** 2 // (p + q)``.

The sum over all terms and pairs of sources is split exactly.  Let ``z`` be the share of a
term that a source does not have.  With ``f(z, z)`` for every term as the base,

* heavy terms, which many sources of the language have, are dense numpy tiles: a slice of
  terms against a block of sources and another block;
* light terms are posting lists: every posting of one source is compared with the ``z`` of
  the others, as a histogram of its shares; and each pair of postings of one term is put
  right by ``f(p, q) - f(p, z) - f(z, q) + f(z, z)``.

Both add their difference from the base, all in whole numbers.

Memory: a tile has at most ``slice`` terms times twice ``block`` sources; posting lists of
light terms have at most ``heavy`` entries; the counts of a task are flushed at ``held``
entries, the pairs at as many; words of long texts are taken in pieces that end between
words.  A word that all documents share is one row for each task and source.

Cases: null text, lang and source are empty text; a source without words, or whose words
are not kept, has count 0 of each term; a language without kept terms has pairs of value 0
and no terms; rows count as documents each, whatever their id; an empty table gives no
row; ties go by the item's bytes; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, letter_words, small, written

#: Shares are in parts of this.
WHOLE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    least_documents: int = 10
    top: int = 10
    #: Terms that more sources of a language have are heavy.
    heavy: int = 6
    #: Sources on one side of a tile.
    block: int = 256
    #: Terms in one tile.
    slice: int = 4_096
    #: Entries of a task's partial sums.
    held: int = 400_000
    #: Bytes of a long text whose words are taken together.
    piece: int = 1 << 22


COUNTED = "lang string, source string, term string, n long, documents long"
PARTIAL = "lang string, a int, b int, value long"


def _counts(s: Settings):
    """Batches of (lang, source, text) as partial counts; a row with an empty term marks a source, with or without words."""

    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            terms, counts, found = [b"", *n], [0, *n.values()], [0, *map(documents.__getitem__, n)]
            for i in range(0, len(terms), 50_000):
                part = slice(i, i + 50_000)
                many = len(terms[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * many), pa.array([source] * many), pa.array(terms[part], pa.binary()).cast(pa.string()), pa.array(counts[part], pa.int64()), pa.array(found[part], pa.int64())],
                    names=["lang", "source", "term", "n", "documents"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for words in letter_words(text.as_buffer().to_pybytes(), s.piece):
                    n.update(words)
                    own.update(words)
                documents.update(own)
                size += len(n) - before
                if size > s.held:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    return run


def counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, term, n, documents over all texts; the row with the empty term stands for the source itself."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*text).mapInArrow(_counts(s), COUNTED)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / total), exactly; 0 where total is 0."""
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = F.lit(WHOLE).cast("decimal(10,0)") * exact(n + F.lit(2), 20)
    return F.when(total > 0, F.lit(1).cast("long") + F.call_function("div", top, exact(total, 20)).cast("long")).otherwise(F.lit(0).cast("long"))


def difference(p: Column, q: Column) -> Column:
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0).cast("long"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _emitted(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    keep = value != 0
    return pd.DataFrame({"lang": np.full(int(keep.sum()), lang, dtype=object), "a": a[keep].astype(np.int32), "b": b[keep].astype(np.int32), "value": value[keep]})


def _zeros(blocks: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    found = blocks[blocks["block"] == block]
    place = np.array(found["places"].iloc[0], np.int64)
    order = np.argsort(place)
    return place[order], np.array(found["zeros"].iloc[0], np.int64)[order]


def _dense(key: tuple, terms: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """A slice of heavy terms against two blocks of sources: differences from the base, summed over the terms."""
    lang, a, b = key[:3]
    (place_a, zero_a), (place_b, zero_b) = _zeros(blocks, a), _zeros(blocks, b)
    base, total = _f(zero_a[:, None], zero_b[None, :]), np.zeros((len(zero_a), len(zero_b)), np.int64)
    step = max(1, 4_000_000 // max(1, base.size))
    for begin in range(0, len(terms), step):
        part = terms.iloc[begin : begin + step]
        sizes = [len(x) for x in part["places"]]
        row, place, p = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["places"].to_list()), np.concatenate(part["shares"].to_list())
        sides = []
        for places, zeros in ((place_a, zero_a), (place_b, zero_b)):
            dense = np.tile(zeros, (len(part), 1))
            at = np.minimum(np.searchsorted(places, place), len(places) - 1)
            here = places[at] == place
            dense[row[here], at[here]] = p[here]
            sides.append(dense)
        total += _f(sides[0][:, :, None], sides[1][:, None, :]).sum(axis=0) - len(part) * base
    return _pairs(lang, a, b, place_a, place_b, total)


def _pairs(lang: str, a: int, b: int, place_a: np.ndarray, place_b: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    left, right = np.repeat(place_a, len(place_b)), np.tile(place_b, len(place_a))
    once = left < right if a == b else np.ones(len(left), bool)
    return _emitted(lang, left[once], right[once], total.ravel()[once])


def _single(key: tuple, shares: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Light postings of the sources of one block against the absent share of the other block's sources, as a histogram of shares."""
    lang, a, b = key[:3]
    (place_a, zero_a), (place_b, zero_b) = _zeros(blocks, a), _zeros(blocks, b)
    total = np.zeros((len(place_a), len(place_b)), np.int64)
    at = np.searchsorted(place_a, shares["place"].to_numpy(np.int64))
    p, n = shares["share"].to_numpy(np.int64), shares["terms"].to_numpy(np.int64)
    for begin in range(0, len(p), 4_096):
        part = slice(begin, begin + 4_096)
        gain = n[part, None] * (_f(p[part, None], zero_b[None, :]) - _f(zero_a[at[part], None], zero_b[None, :]))
        np.add.at(total, at[part], gain)
    left, right = np.repeat(place_a, len(place_b)), np.tile(place_b, len(place_a))
    apart = left != right
    low, high = np.minimum(left, right)[apart], np.maximum(left, right)[apart]
    return _emitted(lang, low, high, total.ravel()[apart])


def _light_pairs(s: Settings):
    """Posting lists of light terms: what each pair of postings of a term puts right, summed in the task."""

    def sums(held: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
        out = {}
        for lang, parts in held.items():
            rows = np.concatenate(parts, axis=1)
            key = rows[0] << 32 | rows[1]
            keys, back = np.unique(key, return_inverse=True)
            value = np.zeros(len(keys), np.int64)
            np.add.at(value, back, rows[2])
            out[lang] = np.stack([keys >> 32, keys & 0xFFFFFFFF, value])
        return out

    def given(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, (a, b, value) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(value)], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            langs, lists = batch.column(0), [batch.column(i) for i in (1, 2, 3)]
            lengths = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
            place, p, z = (pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            coded = langs.dictionary_encode()
            row = np.repeat(np.arange(len(lengths)), lengths)
            lang = coded.indices.to_numpy(zero_copy_only=False)[row]
            for apart in range(1, int(lengths.max(initial=0))):
                i = np.flatnonzero(row[apart:] == row[:-apart])
                j = i + apart
                value = _f(p[i], p[j]) - _f(p[i], z[j]) - _f(z[i], p[j]) + _f(z[i], z[j])
                low, high = np.minimum(place[i], place[j]), np.maximum(place[i], place[j])
                for code, name in enumerate(coded.dictionary.to_pylist()):
                    own = lang[i] == code
                    if own.any():
                        held.setdefault(name, []).append(np.stack([low[own], high[own], value[own]]))
                        size += int(own.sum())
            if size > s.held:
                summed = sums(held)
                size = sum(x.shape[1] for x in summed.values())
                held = {k: [x] for k, x in summed.items()}
                if size > s.held // 2:
                    yield from given(summed)
                    held, size = {}, 0
        yield from given(sums(held))

    return run


def _tiles(blocks: DataFrame) -> DataFrame:
    """Each pair of blocks of a language, first not above second."""
    other = blocks.select("lang", F.col("block").alias("b"))
    return blocks.select("lang", F.col("block").alias("a")).join(other, "lang").where("a <= b")


def _with_blocks(tiles: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """Both blocks of every tile."""
    sides = tiles.select("lang", *keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return sides.join(blocks, ["lang", "block"]).select(*[F.col(c).alias(c) for c in ("lang", *keys, "block", "places", "zeros")])


def pair_sums(terms: DataFrame, groups: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, a, b, value for each pair of a language's sources (a < b, by number).

    ``terms``: lang, term, postings (place, share, zero); ``groups``: lang, source, place, zero, kept; both written.
    """
    numbered = F.col("place") / s.block
    blocks = groups.withColumn("block", F.floor(numbered).cast("int")).groupBy("lang", "block").agg(F.collect_list("place").alias("places"), F.collect_list("zero").alias("zeros"))
    tiles = _tiles(blocks)
    other = groups.select("lang", F.col("place").alias("b"), F.col("zero").alias("zero_b"))
    # One row for each pair of sources: as many as the result has.
    base = groups.join(other, "lang").where(F.col("place") < F.col("b")).select("lang", F.col("place").alias("a"), "b", (F.col("kept") * difference(F.col("zero"), F.col("zero_b"))).alias("value"))

    many = F.size("postings") > s.heavy
    slices = F.when(F.col("kept") > 0, F.ceil(F.col("kept") / s.slice)).otherwise(1).cast("int")
    per_lang = groups.groupBy("lang").agg(F.first(slices).alias("slices"))
    heavy = terms.where(many).join(small(per_lang), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    block_of = lambda p: F.floor(p["place"] / s.block).cast("int")
    heavy = heavy.withColumn("own", F.array_distinct(F.transform("postings", block_of)))
    heavy = heavy.join(F.broadcast(tiles) if _few(tiles) else tiles, "lang").where(F.array_contains("own", F.col("a")) | F.array_contains("own", F.col("b")))
    mine = F.filter("postings", lambda p: block_of(p).isin(F.col("a"), F.col("b")))
    heavy = heavy.select(*[F.col(c).alias(c) for c in ("lang", "a", "b", "slice")], F.transform(mine, lambda p: p["place"]).alias("places"), F.transform(mine, lambda p: p["share"]).alias("shares"))
    sliced = tiles.join(per_lang, "lang").select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    keys = ("a", "b", "slice")
    dense = heavy.groupBy("lang", *keys).cogroup(_with_blocks(sliced, blocks, *keys).groupBy("lang", *keys)).applyInPandas(_tiled(_dense), PARTIAL)

    light = terms.where(~many)
    shares = light.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.place").alias("place"), F.col("p.share").alias("share")).agg(F.count("*").alias("terms"))
    square = blocks.select("lang", F.col("block").alias("a")).join(blocks.select("lang", F.col("block").alias("b")), "lang")
    shares = shares.withColumn("a", F.floor(numbered).cast("int")).join(small(square), ["lang", "a"])
    shares = shares.select(*[F.col(c).alias(c) for c in ("lang", "a", "b", "place", "share", "terms")], (F.col("place") % 16).cast("int").alias("slice"))
    spread = square.select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slice"))
    single = shares.groupBy("lang", *keys).cogroup(_with_blocks(spread, blocks, *keys).groupBy("lang", *keys)).applyInPandas(_tiled(_single), PARTIAL)

    column = lambda name: F.transform("postings", lambda p: p[name]).alias(name)
    both = light.where(F.size("postings") > 1).select("lang", column("place"), column("share"), column("zero")).mapInArrow(_light_pairs(s), PARTIAL)
    parts = base.unionByName(dense).unionByName(single).unionByName(both)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _tiled(work):
    """``work`` for one group; a tile without terms adds nothing."""

    def run(key: tuple, rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or blocks.empty:
            none = np.zeros(0, np.int64)
            return _emitted(key[0], none, none, none)
        return work(key, rows, blocks)

    return run


def _few(df: DataFrame, rows: int = 20_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def divergence(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language (``pair``) and the leading terms (``term``) of each source."""
    counted = written(counts(docs, s), "divergence-counts")
    found = counted.where(F.col("term") != "").groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", F.col("n").alias("n"))).alias("postings")
    )
    kept = written(found.where(F.col("documents") >= s.least_documents).drop("documents"), "divergence-kept")
    langs = counted.where(F.col("term") == "").select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total")), "lang", "left").na.fill(0)
    postings = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("postings").alias("p")).select("lang", "term", "lang_n", "p.source", "p.n")
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counted.where(F.col("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["own"]).join(langs, "lang")
    sized = lambda n: n + 2 * F.col("kept")
    groups = groups.withColumn("whole", sized(F.col("own"))).withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = written(groups.select("lang", "source", "place", "kept", "whole", sized(F.col("total")).alias("lang_whole"), share(F.lit(0), F.col("whole")).alias("zero")), "divergence-groups")

    with_shares = postings.join(small(groups), ["lang", "source"]).withColumn("share", share(F.col("n"), F.col("whole")))
    leading = with_shares.withColumn("q", share(F.col("lang_n"), F.col("lang_whole"))).where(F.col("share") > F.col("q"))
    leading = leading.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("share"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    leading = leading.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)

    terms = written(with_shares.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "share", "zero")).alias("postings")), "divergence-terms")
    pairs = written(pair_sums(terms, groups, s), "divergence-pairs")
    names = lambda side: small(groups.select("lang", F.col("place").alias(side), F.col("source").alias(f"{side}_name")))
    named = pairs.join(names("a"), ["lang", "a"]).join(names("b"), ["lang", "b"])
    both = F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("item")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("item"))))
    paired = named.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    out = paired.unionByName(leading).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
    dropped(counted)
    dropped(terms)
    return out
