"""A stored substring index, and lexical search by it.

Rows are indexed in blocks of some ``LIST`` rows, each where it is read: a block has
one row of its keys, and for each three characters of its lower-cased values the
places of the rows that contain them, as differences. No row a gram and value is
shuffled, and a frequent gram is cut by block. Files are sorted by gram: a filter
on grams reads few pages. A term's candidates are the rows that have its rarest
grams; only these are read and verified. Terms of one or two characters have no
gram: every row is a candidate.

``search`` gives the rows of ``search.lexical_search``. What a chunk may score is
known before its text is read: the terms its grams allow, and its hits on names,
which are exact. Texts are read from the highest bound down, until the wanted
number of chunks score as much as any that are left may.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .search import is_active, terms_of

#: Characters of a gram, rows of a block (65,536 at most), and the rarest grams of a term that are looked up.
GRAM, LIST, RARE = 3, 4096, 4
#: Characters of a block of several rows, at most.
MOST_LETTERS = 8_000_000


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


def gram_column(low: Column) -> Column:
    """Distinct grams of a lower-cased value."""
    last = F.length(low) - (GRAM - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def postings(values: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams of a block's values; where each one's places end; and places by gram, as differences."""
    letters = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(v) for v in values], np.int64)
    row = np.repeat(np.arange(len(values), dtype=np.uint64), lengths)
    known, code = np.unique(letters, return_inverse=True)
    k, n = len(known), len(values)
    code = code.astype(np.uint64)
    inside = row[2:] == row[:-2]  # GRAM letters of one row
    both = ((code[:-2] * np.uint64(k) + code[1:-1]) * np.uint64(k) + code[2:])[inside] * np.uint64(n) + row[2:][inside]
    both = np.unique(both)
    gram, at = both // np.uint64(n), (both % np.uint64(n)).astype(np.int64)
    first = np.flatnonzero(np.diff(gram, prepend=gram[:1] + np.uint64(1)))
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    own = gram[first]
    parts = np.stack([known[(own // np.uint64(k * k)).astype(np.int64)], known[(own // np.uint64(k) % np.uint64(k)).astype(np.int64)], known[(own % np.uint64(k)).astype(np.int64)]], axis=1)
    text = np.ascontiguousarray(parts).tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)], np.append(first[1:], len(both))[: len(first)], steps.astype("<u2")


def _blocks(values: list[str], at: int = 0) -> Iterator[tuple[int, list[str]]]:
    """Runs of values of bounded size, such that a gram and a place are one number of 64 bits."""
    size = sum(map(len, values))
    if len(values) > 1 and (size > MOST_LETTERS or min(size, 0x110000) ** GRAM * len(values) >= 2**64 and len(set().union(*values)) ** GRAM * len(values) >= 2**64):
        half = len(values) // 2
        yield from _blocks(values[:half], at)
        yield from _blocks(values[half:], at + half)
    else:
        yield at, values


def build(rows: DataFrame, key: str, value: str, path: str) -> str:
    """Writes the index of a table; returns the folder."""
    own = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.lower(value).alias("low"))
    most = min(LIST, 65_536)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                for at, values in _blocks(part.column("low").to_pylist()):
                    keys = part.column("key").slice(at, len(values))
                    grams, ends, steps = postings(values)
                    n = len(grams)
                    sizes = np.diff(ends, prepend=0)
                    places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends * 2).astype(np.int32).tobytes()), pa.py_buffer(steps.tobytes())])
                    listed = pa.ListArray.from_arrays(pa.array([0, len(values)] + [len(values)] * n, pa.int32()), keys)
                    name = pa.array([uuid.uuid4().hex] * (n + 1))
                    yield pa.RecordBatch.from_arrays([name, pa.array([None, *grams], pa.string()), pa.array(np.append(len(values), sizes), pa.int32()), pa.concat_arrays([pa.array([b""], pa.binary()), places]), listed], names=["block", "gram", "n", "at", "keys"])

    made = own.mapInArrow(run, f"block string, gram string, n int, at binary, keys array<{own.schema['key'].dataType.simpleString()}>")
    made.sortWithinPartitions("gram").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def _common(batches):
    """The places that all lists of a block and term have."""
    for batch in batches:
        lists = [[np.cumsum(np.frombuffer(x, "<u2").astype(np.int64)) for x in own] for own in batch.column("lists").to_pylist()]
        common = [reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), own) for own in lists]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("term"), pa.array([c.tolist() for c in common], pa.list_(pa.int32()))], names=["block", "term", "places"])


def candidates(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """``key`` and ``term``: rows that have the rarest grams of a term, for terms that have grams."""
    grams = {t: grams_of(t) for t in terms}
    wanted = sorted({g for own in grams.values() for g in own})
    every = spark.read.parquet(path)
    none = every.select(F.explode("keys").alias("key"), F.lit("").alias("term")).where("false")
    if not wanted:
        return none
    posted = every.where(F.col("gram").isin(wanted))
    n = {r.gram: r.n for r in posted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the grams of one question
    chosen = [(t, g, min(RARE, len(own))) for t, own in grams.items() if own and all(g in n for g in own) for g in sorted(own, key=lambda g: (n[g], g))[:RARE]]
    if not chosen:
        return none
    table = F.broadcast(spark.createDataFrame(chosen, "term string, gram string, need int"))
    met = posted.where(F.col("gram").isin(sorted({g for _, g, _ in chosen}))).join(table, "gram")
    lists = met.groupBy("block", "term").agg(F.collect_list("at").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need"))
    found = lists.select("block", "term", "lists").mapInArrow(_common, "block string, term string, places array<int>")
    named = every.where("gram is null").select("block", "keys")
    return found.join(named, "block").select(F.explode(F.transform("places", lambda i: F.element_at("keys", i + 1))).alias("key"), "term")


def matching(rows: DataFrame, key: str, value: str, path: str, terms: list[str], inside: bool = False) -> DataFrame:
    """``key`` and ``term``: rows whose value contains a term (any case); with ``inside`` also rows whose value lies in one."""
    spark = rows.sparkSession
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.lower(value).alias("low"))
    found = own.join(candidates(spark, path, [t for t in terms if len(t) >= GRAM]), "key").where(F.contains("low", F.col("term"))).select("key", "term")
    tiny = [t for t in terms if len(t) < GRAM]
    if tiny:
        found = found.unionByName(own.select("key", F.explode(F.filter(F.array(*map(F.lit, tiny)), lambda t: F.contains("low", t))).alias("term")))
    if inside:
        parts = {(t[i:j], t) for t in terms for i in range(len(t) + 1) for j in range(i, len(t) + 1)}
        lying = F.broadcast(spark.createDataFrame(sorted(parts), "low string, term string"))
        found = found.unionByName(own.join(lying, "low").select("key", "term")).distinct()
    return found


@dataclass(frozen=True)
class TextIndex:
    """Postings of chunk texts, and of the distinct names of entities and of tags."""

    texts: str
    names: str
    tags: str


def index(chunks: DataFrame, mentions: DataFrame, tags: DataFrame, path: str) -> TextIndex:
    names, own = mentions.select("name").distinct(), tags.select("tag").distinct()
    return TextIndex(build(chunks, "chunk_id", "text", f"{path}/texts"), build(names, "name", "name", f"{path}/names"), build(own, "tag", "tag", f"{path}/tags"))


def _name_hits(rows: DataFrame, name: str, path: str, terms: list[str], out: str) -> DataFrame:
    found = matching(rows.select(name).distinct(), name, name, path, terms, inside=True)
    return rows.select("chunk_id", F.col(name).alias("key")).join(found, "key").groupBy("chunk_id").agg(F.count_distinct("term").alias(out))


def search(made: TextIndex, chunks: DataFrame, documents: DataFrame, mentions: DataFrame, tags: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Top chunks by 3 x terms in the text + 2 x terms in entities + terms in tags, read by the index."""
    spark, limit = chunks.sparkSession, max(1, limit)
    terms = terms_of(spark, query)
    out = ["chunk_id", "text", "doc_id", "title", "chunk_index", "score"]
    titled = lambda top: top.join(documents.select("doc_id", "title"), "doc_id", "left").select(*out)
    none = chunks.withColumn("score", F.lit(0.0)).where("false")
    if not terms:
        return titled(none)
    maybe = candidates(spark, made.texts, [t for t in terms if len(t) >= GRAM]).groupBy(F.col("key").alias("chunk_id")).agg(F.count(F.lit(1)).alias("in_text"))
    entity = _name_hits(mentions, "name", made.names, terms, "entity_hits")
    tagged = _name_hits(tags, "tag", made.tags, terms, "tag_hits")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tiny = sum(len(t) < GRAM for t in terms)
    if tiny:
        maybe = chunks.select("chunk_id").join(maybe, "chunk_id", "left").select("chunk_id", (zero("in_text") + tiny).alias("in_text"))
    named = entity.join(tagged, "chunk_id", "full").select("chunk_id", (2 * zero("entity_hits") + zero("tag_hits")).alias("named"))
    bounds = maybe.join(named, "chunk_id", "full").select("chunk_id", zero("named").alias("named"), (3 * zero("in_text") + zero("named")).alias("most"))
    bounds = stored(bounds.join(chunks.where(is_active()).select("chunk_id"), "chunk_id", "left_semi"), "bounds")
    levels = [(r.most, r["count"]) for r in bounds.groupBy("most").count().orderBy(F.desc("most")).collect()]  # six times the terms at most
    at, best = 0, none
    in_text = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    while at < len(levels):
        high, n = at, 0
        while at < len(levels) and n < 4 * limit * (1 + high):
            n += levels[at][1]
            at += 1
        part = bounds.where((F.col("most") <= levels[high][0]) & (F.col("most") >= levels[at - 1][0]))
        near = F.broadcast(part) if n <= 100_000 else part
        read = chunks.join(near, "chunk_id").withColumn("score", (3 * in_text + F.col("named")).cast("double")).where("score > 0")
        best = stored(best.unionByName(read.select(*best.columns)).orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(limit), "best")
        least = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if least.n == limit and at < len(levels) and least.least > levels[at][0]:
            break
    return titled(best)
