"""Passages that repeat across documents: near-equal paragraphs by banded MinHash, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dedup.clusters import connected_components
from ..session import checkpoint, scratch_folder
from .passages import anchors, release, repeated_anchors, repeated_runs
from .simhash import forest
from .tokens import in_pieces, row_of, split_words

SHINGLE = 5
SIMILARITY = 0.8
# Share of pairs at the limit of similarity that the bands bring together, and the most bands for it.
RECALL = 0.9999
MOST_BANDS = 13
# Shorter paragraphs are headings, licence lines and the like and stay.
MIN_WORDS = 20
# Members of a colliding set that are compared in one piece.
TILE = 256
# Documents up to which their ids are sent to every task; beyond, Spark chooses the join.
SEND_ROWS = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band can have so that ``most`` bands still reach the recall.

    A pair of this similarity agrees in a band with probability ``similarity ** rows``; more rows
    bring fewer unlike paragraphs together.
    """
    best = (1, 1)
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)) if similarity < 1 else 1
        if bands > most:
            break
        best = (bands, rows)
    return best


def _scramble(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(29))


class _Paragraphs:
    """Paragraphs (lines) of a batch with at least ``least`` words, as hashes of their shingles."""

    def __init__(self, texts: list[str | None], least: int, shingle: int):
        lines = [(text or "").split("\n") for text in texts]
        every = [line for some in lines for line in some]
        count = np.array([len(some) for some in lines], dtype=np.int64)
        self.document = np.repeat(np.arange(len(lines)), count)
        self.number = np.arange(len(every)) - np.repeat(np.cumsum(count) - count, count)
        self.length = np.array([len(line) for line in every], dtype=np.int64)
        ends = np.cumsum(self.length + 1)
        before = np.append(0, ends)[np.cumsum(count) - count]
        self.start = ends - self.length - 1 - np.repeat(before, count)
        starts, codes, words = split_words(pa.array(every, pa.large_string()))
        self.words = np.diff(starts)
        kept = np.flatnonzero(self.words >= max(1, least))
        hashed = np.array([xxhash.xxh64_intdigest(word) for word in words.to_pylist()], dtype=np.uint64)
        # All words, and where those of each document begin and end.
        self.stream = hashed[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
        self.document_edges = starts[np.append(0, np.cumsum(count))]
        inside = (self.words >= max(1, least))[row_of(starts)]
        stream = self.stream[inside]
        for name in ("document", "number", "length", "start", "words"):
            setattr(self, name, getattr(self, name)[kept])
        begins = np.cumsum(self.words) - self.words
        # A paragraph's key: its words' hashes weighted by the powers of an odd number.
        place = (np.arange(len(stream)) - np.repeat(begins, self.words)).astype(np.uint64)
        key = np.add.reduceat(_scramble(stream + place * _STEP), begins) if len(begins) else stream
        self.key = _scramble(key + self.words.astype(np.uint64)).view(np.int64)
        # Shingles: a paragraph shorter than one is a single, shorter shingle.
        size = np.maximum(1, self.words - shingle + 1)
        self.edges = np.append(0, np.cumsum(size))
        first = np.repeat(begins - self.edges[:-1], size) + np.arange(self.edges[-1])
        width = np.minimum(shingle, np.repeat(self.words, size))
        total = np.zeros(len(first), dtype=np.uint64)
        for step in range(shingle):
            there = step < width
            total[there] = _scramble(total[there] * _STEP + stream[first[there] + step])
        self.shingles = total

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """A key for each paragraph and band, made of the smallest values of ``rows`` hash functions."""
        keys = np.empty((len(self.key), bands), dtype=np.uint64)
        if not len(self.key):
            return keys.view(np.int64)
        factors = np.random.default_rng(11).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for band in range(bands):
            key = np.full(len(self.key), band, dtype=np.uint64)
            for factor in factors[band * rows:(band + 1) * rows]:
                key = _scramble(key * _STEP + np.minimum.reduceat(_scramble(self.shingles * factor), self.edges[:-1]))
            keys[:, band] = key
        return keys.view(np.int64)

    def sets(self, places: np.ndarray) -> list[np.ndarray]:
        return [np.unique(self.shingles[self.edges[n]:self.edges[n + 1]]) for n in places]


LINE = "line"
ANCHOR = "anchor"
_MARKED = ("kind string, doc_id long, text_hash long, paragraph long, start long, length long, n_words long, key long, "
           "bands array<long>, mark long, whole long, at long, size long")


def _marked(documents: DataFrame, folder: str, least: int, shingle: int, bands: int, rows: int, runs: bool
            ) -> tuple[DataFrame, DataFrame]:
    """The paragraphs of all documents and, if ``runs`` are wanted, the anchors of their words (see ``passages``).

    One pass over the texts makes both; they are written to a folder as one table by kind.
    """
    names = [field.split()[0] for field in _MARKED.split(", ")]
    types = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64()), *[pa.int64()] * 4]

    def rows_of(batch: pa.RecordBatch, kind: str, owner: np.ndarray, columns: dict) -> pa.RecordBatch:
        owner = pa.array(owner)
        columns = columns | {"kind": pa.array([kind] * len(owner)), "doc_id": batch["doc_id"].take(owner),
                             "text_hash": batch["text_hash"].take(owner)}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[name], type_) if name in columns and not isinstance(columns[name], pa.Array)
             else columns.get(name, pa.nulls(len(owner), type_)) for name, type_ in zip(names, types)], names=names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            found = _Paragraphs(batch["text"].to_pylist(), least, shingle)
            keys = found.bands(bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield rows_of(batch, LINE, found.document, {
                "paragraph": found.number, "start": found.start, "length": found.length, "n_words": found.words,
                "key": found.key, "bands": lists})
            if runs:
                owner, mark, at, size, whole = anchors(found.stream, found.document_edges)
                yield rows_of(batch, ANCHOR, owner, {"mark": mark, "whole": whole, "at": at, "size": size})

    (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
     .mapInArrow(listed, _MARKED).write.partitionBy("kind").parquet(folder))
    spark = documents.sparkSession
    for kind in (LINE, ANCHOR):
        # There is no folder of a kind without rows.
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kind={kind}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    read = spark.read.schema(_MARKED)
    return (read.parquet(f"{folder}/kind={LINE}").select(names[1:9]),
            read.parquet(f"{folder}/kind={ANCHOR}").select(*names[1:3], *names[9:]) if runs else None)


def _sets(banded: DataFrame) -> DataFrame:
    """``(name, tiles, key)``: sets of two or more keys with one band value; equal sets get one name and are one."""
    many = (banded.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("key")).alias("mixed"))
            .where(F.col("many") > 1)
            .select("band", F.xxhash64("mixed", "many").alias("name"), F.ceil(F.col("many") / TILE).cast("int").alias("tiles")))
    return banded.join(many.hint("shuffle_hash"), "band").select("name", "tiles", "key").distinct()


def _dealt(sets: DataFrame) -> DataFrame:
    """Rows of sets with the pairs of tiles they are compared in; a key's tile follows from the key, so no task holds a set."""
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                        lambda n: F.struct(F.least(own, n).alias("tile"), F.greatest(own, n).alias("other")))
    return (sets.withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair", "tiles")
            .repartition("name", "tile", "other").sortWithinPartitions("name", "tile", "other"))


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted sets of numbers whose Jaccard similarity reaches the limit."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    distinct, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)))
    for begin in range(0, len(distinct), 8192):
        inside = (column >= begin) & (column < begin + 8192)
        held = np.zeros((len(sets), min(8192, len(distinct) - begin)), dtype=np.float32)
        held[row[inside], column[inside] - begin] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    # Whole numbers on both sides, so that a similarity of exactly the limit counts.
    near = np.triu(common >= np.ceil(similarity * union - 1e-9), 1)
    return np.nonzero(near)


def _verified(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            edges = _set_edges(rest)
            if len(edges) > 2:
                yield _set_links(rest, edges[:-1], similarity)
                rest = rest.slice(int(edges[-2]))
        if rest is not None and rest.num_rows:
            yield _set_links(rest, _set_edges(rest), similarity)

    return verified


def _set_edges(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[:1] = True
    for name in ("name", "tile", "other"):
        column = table[name].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def _set_links(table: pa.Table, edges: np.ndarray, similarity: float) -> pa.RecordBatch:
    keys, raw = table["key"].to_numpy(), table["shingles"]
    left, right = [], []
    for begin, end in zip(edges, edges[1:]):
        sets = [np.frombuffer(x, dtype="<u8") for x in raw.slice(begin, end - begin).to_pylist()]
        one, other = similar(sets, similarity)
        label = forest(one, other, np.arange(end - begin))
        linked = np.flatnonzero(label != np.arange(end - begin))
        left.append(keys[begin + linked])
        right.append(keys[begin + label[linked]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _wanted_shingles(documents: DataFrame, first: DataFrame, wanted: DataFrame, least: int, shingle: int) -> DataFrame:
    """``(key, shingles)`` of the wanted keys, from one document that holds each."""
    places = checkpoint(first.join(wanted, "key").groupBy("doc_id").agg(F.collect_list("key").alias("_keys"))
                        .withColumnRenamed("doc_id", "_doc"))
    small = places.count() <= SEND_ROWS
    held = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(places) if small else places, F.col("doc_id").eqNullSafe(F.col("_doc")))
            .select("text", "_keys"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 8 << 20):
            some = _Paragraphs(batch["text"].to_pylist(), least, shingle)
            keys = batch["_keys"]
            owner = row_of(keys.offsets.to_numpy().astype(np.int64))
            flat = keys.flatten().to_numpy()
            pairs = set(zip(owner.tolist(), flat.tolist()))
            hits = np.array([n for n, pair in enumerate(zip(some.document.tolist(), some.key.tolist())) if pair in pairs],
                            dtype=np.int64)
            sets = [s.tobytes() for s in some.sets(hits)]
            yield pa.RecordBatch.from_arrays([pa.array(some.key[hits]), pa.array(sets, pa.binary())],
                                             names=["key", "shingles"])

    return held.mapInArrow(found, "key long, shingles binary").dropDuplicates(["key"])


def repeated_paragraphs(documents: DataFrame, similarity: float = SIMILARITY, least: int = MIN_WORDS,
                        shingle: int = SHINGLE) -> DataFrame:
    """One row for each paragraph that occurs more than once, exactly or nearly.

    Paragraphs are lines of at least ``least`` words; words are lower-cased by A-Z. Two are linked if the Jaccard
    similarity of their sets of ``shingle``-word shingles reaches ``similarity``; links make components.
    Returns ``doc_id, paragraph`` (from 0), ``start, length`` (characters), ``n_words``, the place of the
    component's first paragraph as ``first_doc_id, first_paragraph`` (by doc_id, nulls first, then paragraph),
    ``copies`` (its paragraphs), and ``removed``, true for all but the first. Null and blank texts have no paragraphs; rows
    that repeat a ``doc_id`` and its text repeat its paragraphs, other texts with the same id, null included, are
    documents of their own.

    Equal paragraphs are one row with a count before anything is compared. Colliding sets are named by their members, so
    that a set met in many bands is verified once, and large ones are cut into pairs of tiles. Texts are
    fetched again only for paragraphs that collide. Keys are 64-bit hashes.
    """
    return _repeated(documents, similarity, least, shingle).drop("text_hash")


def _repeated(documents: DataFrame, similarity: float = SIMILARITY, least: int = MIN_WORDS,
              shingle: int = SHINGLE) -> DataFrame:
    """``repeated_paragraphs`` with a hash of the text beside the id."""
    listed, _ = _marked(documents, scratch_folder(documents.sparkSession), least, shingle, *tune_bands(similarity), False)
    return _linked(documents, listed, similarity, least, shingle)


def _linked(documents: DataFrame, listed: DataFrame, similarity: float, least: int, shingle: int) -> DataFrame:
    """Those of the listed paragraphs that occur more than once."""
    place = F.struct("doc_id", "paragraph", "text_hash")
    distinct = checkpoint(listed.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"),
                                                    F.min("bands").alias("bands")))
    release(documents.sparkSession)
    banded = distinct.select("key", F.explode("bands").alias("band"))
    sets = checkpoint(_sets(banded))
    release(documents.sparkSession)
    shingles = _wanted_shingles(documents, distinct.select("key", "first.doc_id"), sets.select("key").distinct(),
                                least, shingle)
    links = (_dealt(sets.join(shingles, "key")).select("name", "tile", "other", "key", "shingles")
             .mapInArrow(_verified(similarity), "a long, b long"))
    labels = connected_components(links).withColumnRenamed("id", "key")
    named = (distinct.select("key", "first", "copies").join(labels, "key", "left")
             .withColumn("label", F.coalesce("label", "key")))
    components = (named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
                  .where(F.col("copies") > 1))
    repeated = named.select("key", "label").join(components, "label").select("key", "first", "copies")
    same = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("paragraph") == F.col("first.paragraph")) & (F.col("text_hash") == F.col("first.text_hash")))
    return (listed.drop("bands").join(repeated, "key")
            .select("doc_id", "paragraph", "start", "length", "n_words", F.col("first.doc_id").alias("first_doc_id"),
                    F.col("first.paragraph").alias("first_paragraph"), "copies", (~same).alias("removed"), "text_hash"))


def repeated_passages(documents: DataFrame, similarity: float = SIMILARITY, least: int = MIN_WORDS,
                      shingle: int = SHINGLE) -> DataFrame:
    """``repeated_paragraphs``, and the runs of 50 and more words that repeat across documents in other lines.

    A run may be part of a longer line or go over several lines, short ones included; it has ``paragraph`` and
    ``first_paragraph`` null. Runs inside repeated paragraphs are not given again.
    """
    spark = documents.sparkSession
    folder = scratch_folder(spark)
    listed, marks = _marked(documents, folder, least, shingle, *tune_bands(similarity), True)
    lines = checkpoint(_linked(documents, listed, similarity, least, shingle))
    del listed
    release(spark, f"{folder}/kind={LINE}")
    marks = repeated_anchors(marks)
    release(spark, f"{folder}/kind={ANCHOR}")
    none = F.lit(None).cast("long")
    runs = repeated_runs(documents, lines.select("doc_id", "text_hash", "start", "length"), marks)
    return lines.drop("text_hash").unionByName(
        runs.drop("first_place").withColumns({"paragraph": none, "first_paragraph": none}))


def drop_repeated(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with repeated paragraphs taken out of ``text``, their first occurrence excepted.

    A text keeps its other lines as they are; a null text stays null. Rows that repeat a ``doc_id`` and its text
    lose the same lines.
    """
    gone = (_repeated(documents, **options).where("removed").groupBy("doc_id", "text_hash")
            .agg(F.collect_set(F.col("paragraph").cast("int")).alias("_gone"))
            .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"}))
    lines = F.filter(F.split("row.text", "\n", -1), lambda line, n: ~F.array_contains("_gone", n))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    # Columns of the documents travel inside one, so that none clashes with those used here.
    return (documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
            .join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("row.text") == F.col("_text")), "left")
            .select(F.col("row").withField("text", text).alias("row")).select("row.*"))
