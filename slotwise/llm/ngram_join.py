"""Documents whose word shingles are similar, by a token-group matrix.

1. One pass gives each document the size and digest of its shingle set and a small sketch.
   Equal sets become one set.
2. Groups: sets that share half of their sketch with one hub are a group, so a cloud of
   near copies is one, whether its members link or not. A group's members are cut into
   blocks, and blocks meet two by two: a set whose overlap with the union of the other block
   cannot reach the threshold is compared with none of its members.
3. The matrix: a set can only be similar to one it shares one of its rarest shingles with
   (a fifth of its own and one). The rarest shingles of all sets are joined across groups;
   that says which groups a query may have to visit.
4. Each group keeps the union of its members' shingles as a bit map. A query's overlap
   with the union bounds its overlap with every member; only groups where the bound
   reaches the threshold are opened, and their members compared with it exactly.

No link is lost: what the unions exclude, and what steps 3 and 4 drop, are only pairs that
cannot reach the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_rows, arrow_schema, components, rows_of, stored
from slotwise.llm.shingles import WORDS, shingles, similar, sketch

PERCENT = 80
#: Shingles in more groups than this are taken last; the number of groups is raised until
#: no more than so many shingles are meant, as every task holds them. Any choice is right.
COMMON_GROUPS, MOST_COMMON = 16, 1_000_000
#: Bits of a group's map per shingle of its union.
BITS = 16
#: Pairs compared in one call, on average; sets of one block of a group, and shingles of
#: its sets together, on average; cells of a matrix.
CELL, BLOCK, BLOCK_SHINGLES, DENSE = 4000, 128, 100_000, 2_000_000
#: Numbers in a sketch, and how many of them a set shares with the hub of its group.
SKETCH, ALIKE = 8, 4
#: The shingles with the smallest hashes, this share of all, are counted and taken first:
#: more than twice what a set has to show, so that there are enough of them beside common ones.
COUNTED = 0.5
#: Parts that the sets of one bucket are dealt to.
SALTS = 3
_LAST = np.uint64(int(COUNTED * 2**64))
#: Texts that Spark hands to Python at a time: each task holds them in both.
ARROW_ROWS = 512


def _stored(df: DataFrame, label: str) -> DataFrame:
    with arrow_rows(df.sparkSession, ARROW_ROWS):
        return stored(df, label)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (size of its set), digest, s0 to s7 (its sketch; null without shingles)."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType(), False),
        T.StructField("digest", T.BinaryType()), *(T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH)),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n, out = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                if len(found):
                    out.append([hashlib.blake2b(found.tobytes(), digest_size=16).digest(), *_signed(sketch(found)).tolist()])
                else:
                    out.append([None] * (1 + SKETCH))
            columns = list(zip(*out, strict=True)) or [()] * (1 + SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(columns[0], arrow.field("digest").type),
                 *(pa.array(c, pa.int64()) for c in columns[1:])], schema=arrow,
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _cells(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with a cell number: a chessboard of hashed left ids by hashed right ids, so
    large that a cell has CELL pairs on average. A text that occurs in many pairs is sent to
    one row or column of the board at most, not to each of its pairs."""
    side = max(4, math.isqrt(pairs.count() // CELL) + 1)
    return pairs.withColumn(
        "cell", F.pmod(F.xxhash64(left), F.lit(side)) * side + F.pmod(F.xxhash64(F.lit(1), right), F.lit(side))
    )


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns under new names, so that a frame can meet another made from it."""
    return df.select(*[F.col(c).alias(f"{c}_") for c in df.columns])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) of document ids of which any texts are similar."""
    pairs = _cells(pairs.select("a", "b"), "a", "b")
    ids = pairs.select("cell", F.col("a").alias("doc_id")).unionByName(pairs.select("cell", F.col("b").alias("doc_id")))
    texts = ids.distinct().join(docs.select("doc_id", "text"), "doc_id").select("cell", "doc_id", "text")

    def compare(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list[np.ndarray]] = {}
        for doc, text in zip(held.doc_id, held.text, strict=True):
            found = shingles(text, words)
            if not any(np.array_equal(found, known) for known in sets.get(doc, ())):
                sets.setdefault(doc, []).append(found)
        kept = [
            any(similar(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ()))
            for a, b in zip(asked.a_, asked.b_, strict=True)
        ]
        return asked.loc[kept, ["a_", "b_"]].set_axis(["a", "b"], axis=1)

    checked = texts.groupBy("cell").cogroup(_renamed(pairs).groupBy("cell_")).applyInPandas(compare, "a long, b long")
    return _stored(checked, label)


def _attached(sets: DataFrame) -> DataFrame:
    """(a, b): each set with a hub it shares at least ALIKE of the SKETCH numbers with.

    The sets that share a number are a bucket; its hub is the set whose own buckets are the
    largest: near copies that were changed least share most numbers with the others. Rows of
    a bucket are dealt to SALTS parts, and what is known of it is sent to each.
    """
    buckets = sets.select("rep", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("low")) for k in range(SKETCH)
    ])).alias("bucket")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = _stored(buckets.join(sizes.select("*", salts), ["bucket", "salt"]), "join-buckets")
    weight = sized.groupBy("rep").agg(F.sum("n").alias("weight"))
    hubs = sized.join(weight, "rep").groupBy("bucket").agg(
        F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("b")
    )
    shared = sized.join(hubs.select("*", salts), ["bucket", "salt"]).where("rep <> b").groupBy(F.col("rep").alias("a"), "b").count()
    return shared.where(F.col("count") >= ALIKE).select("a", "b")


def _joined(cells: DataFrame, keys: list[str], words: int, percent: int, label: str) -> DataFrame:
    """Edges (a, b) that join all linked sets of each cell: one per set and cell at most.

    A cell's sets on side 0 are compared with those on side 1, or with each other where it
    has no side 1, in one matrix product of sets by shared shingles. Pairs are never rows.
    """

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["rep", "side"], kind="stable")
        found, ids, side = [shingles(t, words) for t in cell.text], cell.rep.to_numpy(), cell.side.to_numpy()
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if side.any() else one
        x, y = _linked_pairs([found[k] for k in one], [found[k] for k in two], percent, two is one)
        node, root = _spanning(one[x], two[y], len(ids))
        kept = ids[node] != ids[root]
        return pd.DataFrame({"a": ids[node][kept], "b": ids[root][kept]})

    return _stored(cells.select(*keys, "side", "rep", "text").groupBy(*keys).applyInPandas(compare, "a long, b long"), label)


def _numbered(column: str, blocks: str):
    return F.pmod(F.xxhash64(column), blocks).cast("int")


def _within(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges that join all linked sets of each group: every two of its members are compared,
    each pair of its blocks in one cell. A text goes to as many cells as its group has blocks."""
    member = texts.where("blocks is not null").withColumn("own", _numbered("rep", "blocks"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "text",
    )
    return _joined(dealt, ["grp", "i", "j"], words, percent, "join-within")


def _visited(opened: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges that join the queries (a, grp) with all members they link to: a block of queries
    and a block of members meet in one cell."""
    asked = opened.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("calls"))
    sizes = texts.where("rep = grp").select("grp", "blocks").distinct().join(asked, "grp")
    queries = opened.join(sizes, "grp").join(texts.select(F.col("rep").alias("a"), "text"), "a").select(
        "grp", _numbered("a", "calls").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        F.lit(0).alias("side"), F.col("a").alias("rep"), "text",
    )
    members = texts.join(asked, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("calls") - 1)).alias("i"), _numbered("rep", "blocks").alias("j"),
        F.lit(1).alias("side"), "rep", "text",
    )
    return _joined(queries.unionByName(members), ["grp", "i", "j"], words, percent, "join-visited")


def _linked_pairs(one: list[np.ndarray], two: list[np.ndarray], percent: int, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the similar pairs of two lists of sets; with ``same`` they are one list.

    A set is compared only if its overlap with the union of the other list (of its own list:
    with what two sets have at least) can reach the threshold with one of them.
    """
    none, sets = np.empty(0, dtype="int64"), one if same else one + two
    sizes, cut = np.array([len(s) for s in sets]), len(sets) if same else len(one)
    if not sizes[:cut].any() or not (same or sizes[cut:].any()):
        return none, none
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    if same:
        met = counts[column] > 1
    else:
        first = np.bincount(column[row < cut], minlength=len(counts))
        met = np.where(row < cut, first[column] < counts[column], first[column] > 0)
    may = (sizes > 0) & (100 * np.bincount(row, met, len(sets)) >= percent * sizes)
    left, right = np.flatnonzero(may[:cut]), np.flatnonzero(may if same else may[cut:])
    if not len(left) or not len(right):
        return none, none
    kept = met & may[row]
    row, column = (np.cumsum(may) - 1)[row[kept]], np.unique(column[kept], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    common = _products(row[order], column[order], int(may.sum()), len(left), same)
    own, other = sizes[left], sizes[right if same else right + cut]
    x, y = np.nonzero(100 * common >= percent * (own[:, None] + other[None, :] - common))
    return left[x], right[y]


def _products(row: np.ndarray, column: np.ndarray, n: int, left: int, same: bool) -> np.ndarray:
    """Shingles that each of the first ``left`` of ``n`` sets shares with each of the others
    (with ``same``: of all), from (set, shingle) places in the order of the shingles; a
    matrix product over so many shingles at a time as fit."""
    common = np.zeros((left, n if same else n - left))
    width, step = int(column[-1]) + 1 if len(column) else 0, max(1, DENSE // max(1, n))
    for low in range(0, width, step):
        part = slice(*np.searchsorted(column, (low, low + step)))
        matrix = np.zeros((n, min(step, width - low)), dtype="float32")
        matrix[row[part], column[part] - low] = 1
        common += matrix[:left] @ (matrix if same else matrix[left:]).T
    return common


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A node and the smallest node reachable from it, for the nodes that are not smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def _emitted(texts: DataFrame, words: int, percent: int, common: np.ndarray | None = None) -> DataFrame:
    """Without ``common``: the counted shingles of each group's first set, as 48 bits of
    their hashes. With it: the first shingles of every set in one order of all shingles, as
    many as make sure that similar sets share one: counted ones that are not common, then
    those not counted, then the common ones, each by hash. low and high are 0 for groups of one."""
    fields = [T.StructField("shingle", T.LongType(), False)]
    if common is not None:
        fields += [T.StructField(k, T.LongType()) for k in ("rep", "grp", "n", "low", "high")]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            parts, rows = [], []
            for rep, group, low, high, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found = shingles(text, words)
                counted = found[: np.searchsorted(found, _LAST)]
                if common is None:
                    parts.append(_short(counted))
                    continue
                own = _short(counted)
                at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
                last = common[at] == own if len(common) else np.zeros(len(own), dtype=bool)
                need = len(found) - -(-len(found) * percent // 100) + 1
                rows.append((rep, group, len(found), low or 0, high or 0, need))
                parts.append(_signed(np.concatenate([counted[~last], found[len(counted):], counted[last]])[:need]))
            columns = [pa.array(np.concatenate(parts) if parts else np.empty(0, dtype="int64"))]
            if common is not None:
                each = np.array(rows, dtype="int64").reshape(-1, 6)
                columns += [pa.array(np.repeat(each[:, k], each[:, 5])) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    if common is None:
        texts = texts.where("rep = grp")
    return texts.select("rep", "grp", "low", "high", "text").mapInArrow(run, schema)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(16)).astype("int64")


def _common(texts: DataFrame, words: int, percent: int, least: int, most: int) -> np.ndarray:
    """Sorted 48-bit hashes of the counted shingles that occur in more than ``least`` groups, or in more
    than the number that leaves ``most`` of them."""
    counts = _emitted(texts, words, percent).groupBy("shingle").count().where(F.col("count") > least)
    counts = _stored(counts, "join-common")
    sizes = counts.groupBy(F.ceil(F.log2("count")).alias("power")).count().collect()  # one row per power of two
    total, floor = 0, least
    for row in sorted(sizes, key=lambda r: -r.power):
        total += row["count"]
        if total > most:
            floor = max(floor, 2 ** int(row.power))
            break
    rows = counts.where(F.col("count") > floor).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().astype("int64"))


def _maps(texts: DataFrame, words: int) -> DataFrame:
    """grp, bits: the union of the members' shingles, each shingle one bit. The length is a
    power of two set by the largest member; the maps of a group's members are joined bit by
    bit on the way, so that no group's shingles are gathered."""
    wide = texts.select("grp", F.col("high").alias("largest"), "text")
    schema = T.StructType([
        T.StructField("grp", T.LongType(), False), T.StructField("word", T.IntegerType(), False),
        T.StructField("bits", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            owner, place, bits = [], [], []
            for group, largest, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words_, values = _bitmap(shingles(text, words), largest)
                owner.append(np.full(len(words_), group))
                place.append(words_)
                bits.append(values)
            if owner:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(owner)), pa.array(np.concatenate(place).astype("int32")),
                     pa.array(_signed(np.concatenate(bits)))], schema=arrow,
                )

    pieces = wide.mapInArrow(run, schema).groupBy("grp", "word").agg(F.bit_or("bits").alias("bits"))
    sized = texts.where("rep = grp").select("grp", F.col("high").alias("largest")).distinct()
    whole = pieces.groupBy("grp").agg(F.collect_list(F.struct("word", "bits")).alias("map")).join(sized, "grp")
    return whole.select("grp", "largest", F.col("map.word").alias("words"), F.col("map.bits").alias("bits"))


def _length(largest: int) -> int:
    """Bits of a map for sets of up to ``largest`` shingles."""
    return 1 << max(6, (BITS * largest - 1).bit_length())


def _bitmap(hashes: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a set's bit map that are not empty."""
    at = hashes & np.uint64(_length(largest) - 1)
    place, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
    bits = np.zeros(len(place), dtype=np.uint64)
    np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
    return place.astype("int64"), bits


def _opened(visits: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The visits (a, grp) where the overlap of any text of a with the group's union can reach the threshold."""
    visits = _cells(visits, "a", "grp")
    maps = _maps(texts.join(visits.select("grp").distinct(), "grp", "left_semi"), words)
    own = visits.select("cell", "a").distinct().join(texts.select(F.col("rep").alias("a"), "text"), "a")
    held = visits.select("cell", "grp").distinct().join(maps, "grp")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("largest", "long"), ("words", "array<int>"), ("bits", "array<long>"))]
    held = held.select("cell", "grp", F.lit(None).cast("string").alias("text"), "largest", "words", "bits").unionByName(
        own.select("cell", F.col("a").alias("grp"), "text", *none)
    )

    def overlap(found: np.ndarray, size: int, union: np.ndarray) -> int:
        at = found & np.uint64(size - 1)
        return int(((union[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).sum())

    def bound(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, tuple[int, np.ndarray]] = {}
        sets: dict[int, list[np.ndarray]] = {}
        for key, text, largest, at, bits in zip(held.grp, held.text, held.largest, held.words, held.bits, strict=True):
            if at is None:
                sets.setdefault(key, []).append(shingles(text, words))
            else:
                size = int(largest)
                union = np.zeros(_length(size) // 64, dtype=np.uint64)
                union[np.asarray(at)] = np.asarray(bits, dtype="int64").view(np.uint64)
                groups[key] = (_length(size), union)
        kept = []
        for a, group in zip(asked.a_, asked.grp_, strict=True):
            size, union = groups[group]
            kept.append(any(100 * overlap(found, size, union) >= percent * len(found) for found in sets[a]))
        return asked.loc[kept, ["a_", "grp_"]].set_axis(["a", "grp"], axis=1)

    return _stored(
        held.groupBy("cell").cogroup(_renamed(visits).groupBy("cell_")).applyInPandas(bound, "a long, grp long"), "join-opened"
    )


def linked(
    docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS, common_groups: int = COMMON_GROUPS,
    most_common: int = MOST_COMMON, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Connected documents: doc_id, n_shingles, component_id, one row per row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of
    ``words``-word shingles; component_id is the smallest doc_id reachable. Null or empty
    texts, and texts of blanks, have no shingles and link with nothing (their own id).
    Fewer words than ``words``: the whole sequence is the one shingle. Rows without id have
    a null component and link with nothing. Rows that repeat an id count as one document
    with several texts. Very long texts are read whole. An empty table gives no rows. Other
    columns are not read. Sets are told apart by size and a 128-bit digest, shingles by
    64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = _stored(signatures(docs, words=words), "join-signatures")
    sets = _stored(
        signed.where("n > 0 and doc_id is not null").groupBy("n", "digest").agg(
            F.min("doc_id").alias("rep"), *[F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]
        ), "join-sets",
    )
    known = docs.where("doc_id is not null")
    groups = components(_attached(sets), "join-groups").select(F.col("id").alias("rep"), "component")
    grouped = sets.select("rep", "n").join(groups, "rep", "left").select(
        "rep", "n", F.coalesce("component", "rep").alias("grp")
    )
    grouped = _stored(grouped, "join-grouped")
    # What a set must know of its group is joined to numbers, before its text comes along.
    sizes = grouped.groupBy("grp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members"),
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    ).where("members > 1").drop("members")
    grouped = grouped.join(sizes, "grp", "left")
    texts = _stored(
        grouped.join(known, grouped.rep == known.doc_id).select("rep", "grp", "n", "low", "high", "blocks", "text"), "join-texts"
    )
    near = _within(texts, words, percent)

    common = _common(texts, words, percent, common_groups, most_common)
    rare = _stored(_emitted(texts, words, percent, common), "join-rare")
    shared = rare.groupBy("shingle").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high")
    rare = _stored(rare.join(shared.select("shingle"), "shingle"), "join-shared")
    alone = rare.where("low = 0").select("shingle", "rep", "n")
    fits = (100 * F.col("n") >= percent * F.col("n_2")) & (100 * F.col("n_2") >= percent * F.col("n"))
    # A group of one is its own union: its set is compared at once, the tightest bound.
    other = alone.select("shingle", F.col("rep").alias("rep_2"), F.col("n").alias("n_2"))
    met = alone.join(other, "shingle").where("rep < rep_2").where(fits).select(
        F.col("rep").alias("a"), F.col("rep_2").alias("b")
    )
    # The matrix has a shingle and a group once, however many members share it. Of two
    # groups, the sets of the first visit the second.
    matrix = rare.where("low > 0").select("shingle", *[F.col(c).alias(f"{c}_2") for c in ("grp", "low", "high")]).distinct()
    visits = rare.join(matrix, "shingle").where("grp <> grp_2 and (low = 0 or grp < grp_2)").where(
        (100 * F.col("n") >= percent * F.col("low_2")) & (100 * F.col("high_2") >= percent * F.col("n"))
    )
    visits = _stored(visits.select(F.col("rep").alias("a"), F.col("grp_2").alias("grp")).distinct(), "join-visits")
    opened = _opened(visits, texts, words, percent)
    visited = _visited(opened, texts, words, percent)
    across = _verified(
        _stored(met.distinct(), "join-met"), texts.select(F.col("rep").alias("doc_id"), "text"), words, percent, "join-across"
    )

    # A repeated id ties its texts' sets together.
    named = signed.join(sets.select("n", "digest", "rep"), ["n", "digest"])
    several = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b < high")
    tied = named.join(several, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")
    found = components(near.unionByName(visited).unionByName(across).unionByName(tied), "join")
    homes = sets.select("n", "digest", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "digest", F.coalesce("component", "rep").alias("component")
    )
    return signed.join(homes, ["n", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of connected ones: that with the smallest id.

    All columns are kept. Of rows that repeat an id the smallest stays, by the columns in
    their order; rows without id all stay, as do documents without words.
    """
    kept = linked(docs.select("doc_id", "text"), percent=percent).where("doc_id = component_id").select("doc_id").distinct()
    own = docs.columns
    first = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*own)).alias("row"))
    return first.select("row.*").select(*own).unionByName(docs.where("doc_id is null"))
