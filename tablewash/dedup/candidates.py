"""Which records are compared: all, neighbours in the order of one column, or equal blocks.

Candidate pairs are never written out. Records equal in every compared column collapse into one
*signature* with a number of copies; signatures are dealt into tiles of bounded size; a *cell* is a
pair of tiles (or a tile with itself) whose signatures are compared with each other in one task.
Every candidate pair belongs to exactly one cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import with_neighbours
from ..functions.text import float_text
from ..session import checkpoint
from ..types import AttrTypeError, InvalidValueError, col, is_date, is_integer, type_of
from .segments import key_sizes, segment_keys

# Signatures per tile, on average.
TILE = 1024
# Texts of up to this many signs fill whole tiles. Longer ones make tiles smaller, so that no cell takes long, down to
# this many signatures, and as long as a block has no more than this many tiles, as each of them copies the block once.
TILE_TEXT, LEAST_TILE, MOST_TILES = 128, 64, 16
# Most signatures in a tile of a whole table, and the least number of cells that its outsiders are dealt into.
MOST_ROWS, LEAST_CELLS = 500_000, 128
# Where groups of equal signatures meet a whole table: most of its rows in a cell, and the cells they are dealt into.
GROUPED_ROWS, GROUPED_CELLS = 2_000_000, 32
CELL = ["block", "kind", "row_tile", "col_tile", "side"]


@dataclass
class Candidates:
    """Signatures ``(keys, _s0.., sid, copies)``; the compared columns; the index to pair them by.

    With ``similarity`` only pairs are wanted that reach it in at least one column.
    """

    signatures: DataFrame
    keys: list[str]
    columns: list[str]
    index: str
    similarity: float | None = None

    @property
    def texts(self) -> list[str]:
        return [f"_s{i}" for i in range(len(self.columns))]


def compared_columns(df: DataFrame, id_column: str, ignore: Sequence[str] = ()) -> list[str]:
    """All columns but the row id, the ignored ones and dates."""
    return [c for c in df.columns if c != id_column and c not in ignore and not is_date(type_of(df, c))]


def as_text(df: DataFrame, column: str) -> Column:
    kind = type_of(df, column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(col(column), keep_point=True, plain_below=1e16)
    return col(column).cast("string")


def candidates(df: DataFrame, id_column: str, exact: Sequence[str] = (), ignore: Sequence[str] = ()) -> Candidates:
    """Candidate pairs: every pair, neighbours by one exact column, or blocks of two and more."""
    if not is_integer(type_of(df, id_column)):
        raise AttrTypeError(f'row id "{id_column}" must be an integer column')
    columns = compared_columns(df, id_column, ignore)
    if not columns:
        raise InvalidValueError("no column is left to compare")
    keys = [col(c).alias(f"_k{i}") for i, c in enumerate(exact)]
    names = [f"_k{i}" for i in range(len(keys))]
    texts = [as_text(df, c).alias(f"_s{i}") for i, c in enumerate(columns)]
    rows = df.select(col(id_column).cast("long").alias("sid"), *keys, *texts)
    grouped = (rows.dropna(subset=names or None, how="any") if names else rows)
    signatures = (grouped.groupBy(*names, *[f"_s{i}" for i in range(len(columns))])
                  .agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("copies")))
    index = "full" if not names else "neighbours" if len(names) == 1 else "block"
    return Candidates(signatures, names, columns, index)


def blocks(df: DataFrame, exact: Sequence[str]) -> DataFrame:
    """Blocks of rows equal in all given columns: size and number of candidate pairs of each."""
    size = F.count(F.lit(1))
    return (df.dropna(subset=list(exact)).groupBy(*[col(c) for c in exact])
            .agg(size.alias("row_count")).where("row_count > 1")
            .withColumn("pair_count", (F.col("row_count") * (F.col("row_count") - 1) / 2).cast("long")))


def neighbourhoods(df: DataFrame, column: str) -> DataFrame:
    """Per value of a column: its rows, the next value in sorted order, and the candidate pairs it starts.

    Rows are paired with the rows of the same and of the next value.
    """
    sizes = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("row_count"))
    around = with_neighbours(sizes, "value", ["value", "row_count"])
    rows, following = F.col("row_count"), F.coalesce("next_row_count", F.lit(0))
    return around.select("value", "row_count", "next_value",
                         (rows * (rows - 1) / 2 + rows * following).cast("long").alias("pair_count"))


def cells(found: Candidates) -> DataFrame:
    """Signatures with the cells they take part in; a signature appears once per cell.

    In a cell of one tile with itself all have side 0; else side 0 is compared with side 1.
    """
    signatures = found.signatures
    if found.index == "full":
        block, size = signatures.agg(F.min("sid"), F.count(F.lit(1))).first()
        members = signatures.withColumns({"block": F.lit(block).cast("long"), "tiles": F.lit(_table_tiles(size))})
        places = _own(F.col("tiles"))
    else:
        longest = F.greatest(*[F.coalesce(F.length(t), F.lit(0)) for t in found.texts], F.lit(0))
        sizes = signatures.groupBy(*found.keys).agg(F.min("sid").alias("block"), F.count(F.lit(1)).alias("size"),
                                                    F.avg(longest).alias("signs"))
        sizes = sizes.withColumn("tiles", _tiles_of_texts("size", "signs")).drop("signs")
        if found.index == "block":
            members = signatures.join(sizes.where("size > 1"), found.keys)
            places = _own(F.col("tiles"))
        else:
            sizes = with_neighbours(sizes, found.keys[0], ["block", "tiles"])
            members = signatures.join(sizes, found.keys)
            places = F.concat(_own(F.col("tiles")), _with_next(), _with_previous())
    tile = F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")
    return (members.withColumn("tile", tile).withColumn("cell", F.explode(places))
            .select("cell.*", "sid", "copies", *found.texts))


def similar_cells(found: Candidates) -> DataFrame | None:
    """Cells of a whole table in which the pairs meet that reach ``found.similarity`` in a column, if these are few."""
    return _segment_cells(found, found.signatures.count())


def outside_cells(found: Candidates, outside: DataFrame, outsiders: int, size: int) -> DataFrame:
    """Cells that compare the signatures whose ``sid`` stands in ``outside`` with all of the table."""
    rows = min(-(-outsiders // TILE), MOST_TILES)
    columns = max(-(-LEAST_CELLS // rows), -(-size // MOST_ROWS))

    def dealt(own: int, others: int, side: int) -> DataFrame:
        tile = F.pmod(F.xxhash64("sid"), F.lit(own)).cast("int")
        return signatures.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda other: _cell(
            "block", 1, other if side else tile, tile if side else other, F.lit(side)))))

    signatures = found.signatures.withColumn("block", F.lit(0).cast("long"))
    placed = (dealt(rows, columns, 0).join(outside.select("sid"), "sid", "left_semi")
              .unionByName(dealt(columns, rows, 1)))
    return placed.select("cell.*", "sid", "copies", *found.texts)


def grouped_cells(found: Candidates, group: list[str]) -> DataFrame:
    """Cells of a whole table in which all signatures equal in some texts (side 0) meet all others and themselves (side 1)."""
    signatures = found.signatures.withColumn("block", F.lit(0).cast("long"))
    columns = -(-signatures.count() // GROUPED_ROWS)

    def dealt(own: Column, others: int, side: int) -> DataFrame:
        return signatures.withColumn("tile", own.cast("int")).withColumn("cell", F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(others - 1)), lambda other: _cell(
                "block", 1, other if side else F.col("tile"), F.col("tile") if side else other, F.lit(side)))))

    placed = (dealt(F.pmod(F.xxhash64(*group), F.lit(GROUPED_CELLS)), columns, 0)
              .unionByName(dealt(F.pmod(F.xxhash64("sid"), F.lit(columns)), GROUPED_CELLS, 1)))
    return placed.select("cell.*", "sid", "copies", *found.texts)


def _segment_cells(found: Candidates, size: int) -> DataFrame | None:
    """Cells of records that share a key of segments, or None if these hold more pairs than the whole table has.

    Pairs may meet more than once, which makes no difference to the links between records.
    """
    blocks_ = checkpoint(key_sizes(found.signatures, found.texts, found.similarity)
                         .where("row_size > 0 AND col_size > 0 AND first < last").select("block", "row_size", "col_size"))
    pairs = blocks_.agg(F.sum(F.col("row_size").cast("double") * F.col("col_size"))).first()[0] or 0.0
    if pairs > size * (size - 1) / 2:
        return None
    keyed = checkpoint(segment_keys(found.signatures, found.texts, found.similarity).join(
        blocks_.select("block"), "block", "left_semi"))
    row_side = F.col("side") == 0
    own = F.pmod(F.xxhash64("sid"), F.when(row_side, _tiles("row_size")).otherwise(_tiles("col_size"))).cast("int")
    others = F.sequence(F.lit(0), F.when(row_side, _tiles("col_size")).otherwise(_tiles("row_size")) - 1)
    place = F.transform(others, lambda other: _cell(
        "block", 1, F.when(row_side, own).otherwise(other), F.when(row_side, other).otherwise(own), F.col("side")))
    return (keyed.join(blocks_, "block").select("sid", F.explode(place).alias("cell"))
            .join(found.signatures.select("sid", "copies", *found.texts), "sid")
            .select("cell.*", "sid", "copies", *found.texts))


def _table_tiles(size: int) -> int:
    """Tiles of a whole table: as each of them copies the table once, their number does not grow with it."""
    return max(1, min(-(-size // TILE), MOST_TILES), -(-size // MOST_ROWS))


def _tiles(size: str) -> Column:
    return F.ceil(F.col(size) / TILE).cast("int")


def _tiles_of_texts(size: str, signs: str) -> Column:
    rows = F.greatest(F.lit(min(LEAST_TILE, TILE)), F.least(F.lit(TILE), F.lit(TILE * TILE_TEXT) / F.greatest(F.col(signs), F.lit(1))))
    return F.greatest(_tiles(size), F.least(F.lit(MOST_TILES), F.ceil(F.col(size) / rows))).cast("int")


def _cell(block: str, kind: int, row_tile: Column, col_tile: Column, side: Column) -> Column:
    return F.struct(F.col(block).alias("block"), F.lit(kind).alias("kind"), row_tile.alias("row_tile"),
                    col_tile.alias("col_tile"), side.alias("side"))


def _own(tiles: Column) -> Column:
    """Cells of a block with itself: each pair of tiles once."""
    tile = F.col("tile")
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda other: _cell(
        "block", 0, F.least(tile, other), F.greatest(tile, other), (tile > other).cast("int")))


def _with_next() -> Column:
    cells_ = F.transform(F.sequence(F.lit(0), F.col("next_tiles") - 1), lambda other: _cell(
        "block", 1, F.col("tile"), other, F.lit(0)))
    return F.when(F.col("next_block").isNotNull(), cells_).otherwise(F.array().cast(_CELLS))


def _with_previous() -> Column:
    cells_ = F.transform(F.sequence(F.lit(0), F.col("prev_tiles") - 1), lambda other: _cell(
        "prev_block", 1, other, F.col("tile"), F.lit(1)))
    return F.when(F.col("prev_block").isNotNull(), cells_).otherwise(F.array().cast(_CELLS))


_CELLS = "array<struct<block:bigint,kind:int,row_tile:int,col_tile:int,side:int>>"
