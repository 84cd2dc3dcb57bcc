"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Plan
 1. Every text becomes its set of distinct word shingles, as sorted 64-bit hashes. Equal sets are one class.
 2. A pair of classes with Jaccard >= t shares a shingle among the first n - ceil(t*n) + 1 of either set, in any
    fixed order of all shingles. The order used puts shingles that are frequent in the corpus last (found by lossy
    counting over all documents), so a passage shared by many documents makes no large lists. Any order gives the
    same links; only the work differs.
 3. A shingle's list is cut into blocks by size, from its counts by size, and a tile is a pair of blocks of compatible
    sizes; nearly all lists are one block. In a tile, classes are compared by bitmap: a parity bitmap as wide as the
    size band needs gives |A xor B| >= popcount, hence overlap <= (|A| + |B| - popcount) / 2. Survivors of a tile are
    joined by at most one edge per member, and the connected components of these edges hold all links.
 4. The components are cut into blocks and tiles in the same way, with blocks of about equal numbers of shingles. In a
    tile the bitmap bound runs over the block pairs and what passes is intersected exactly. A tile returns link counts
    and at most one edge per row, never its pairs.

Results: one row per input row, each with its own text: rows with a repeated or null doc_id are linked as good as
others and count as partners of their own. component_id is the smallest doc_id of a row that links reach, null if
there is none. A null or empty text has the empty set, is linked with nothing and is its own component. Ties cannot
occur: the component is the smallest id. A table without rows gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import shingle_set, word_hashes
from ..storage import shared_table
from .common import components, drop_ids, map_rows, may_be_in, pieces, raw_texts, row_keyed, small_batches, split_by_ids


def required_prefix(n: int, num: int, den: int) -> int:
    """How many leading shingles of a set of n must be looked at so that no pair at or above num/den is missed."""
    return n - (-(-n * num // den)) + 1


def bitmap_bits(n: int) -> int:
    """Width of the parity bitmap for a set size: a power of two at or above n, from 64 to 16384."""
    return 1 << min(14, max(6, int(n - 1).bit_length()))


def parity_bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Bit k is the parity of the number of shingles with hash = k modulo bits; as 64-bit words."""
    odd = (np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _fold(m: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps (rows) narrowed to so many 64-bit words."""
    while m.shape[-1] > words:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def _enough(overlap, n1, n2, num: int, den: int):
    """overlap / union >= num / den in whole numbers."""
    return (den + num) * overlap >= num * (n1 + n2)


def _overlap_bound(bits_a: np.ndarray, n_a: int, bits_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    w = min(bits_a.shape[-1], bits_b.shape[-1])
    differ = np.bitwise_count(_fold(bits_a, w) ^ _fold(bits_b, w)).sum(axis=-1, dtype=np.int64)
    return (n_a + n_b - differ) // 2


def _sets(docs: DataFrame, n: int, heavy, num: int, den: int) -> DataFrame:
    """row, doc_id, size, 128-bit fingerprint, leading shingles and bitmap of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        last = heavy.value
        size, f1, f2, prefix, bits = [], [], [], [], []
        for _, words in word_hashes(raw_texts(batch.column(2))):
            s = shingle_set(words, n)
            size.append(len(s))
            if not len(s):
                f1.append(0), f2.append(0), prefix.append([]), bits.append(b"")
                continue
            with np.errstate(over="ignore"):
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))).view(np.int64)))
            late = np.zeros(len(s), dtype=bool)
            if len(last):
                at = np.searchsorted(last, s)
                at[at == len(last)] = 0
                late = last[at] == s
            prefix.append(np.concatenate([s[~late], s[late]])[: required_prefix(len(s), num, den)].view(np.int64))
            # Over half a bit per shingle is enough to tell unrelated sets, and halves what the lists carry.
            bits.append(parity_bitmap(s, bitmap_bits(len(s) * 5 // 8 + 1)).tobytes())
        return {"row": batch.column(0), "doc_id": batch.column(1), "n": pa.array(size, pa.int64()), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary())}

    return map_rows(docs, run, "row long, doc_id long, n long, f1 long, f2 long, prefix array<long>, bits binary")


def frequent_shingles(docs: DataFrame, n: int = 5, share: float = 0.0002, at_least: int = 20) -> np.ndarray:
    """Sorted hashes of shingles that lossy counting over all documents finds in about share of them or more.

    There are at most (mean shingles a document) / share of them, whatever the number of documents.
    """

    def run(it):
        pending, held, rows = [], 0, 0
        for batch in it:
            for piece in pieces(batch):
                for _, words in word_hashes(raw_texts(piece.column(0))):
                    pending.append(shingle_set(words, n))
                    held += len(pending[-1])
                    rows += 1
                    if held > 600_000:
                        yield flush(pending, rows)
                        pending, held, rows = [], 0, 0
        if pending:
            yield flush(pending, rows)

    def flush(sets: list, rows: int) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(sets), return_counts=True)
        keep = c >= max(2, 2 * share * rows)
        return pa.RecordBatch.from_pydict({"h": u[keep].view(np.int64), "c": c[keep].astype(np.int64)})

    total = docs.count()
    rows = small_batches(docs.select("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(at_least, share * total)).select("h")
    found = rows.toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _list_edges(it, num: int, den: int):
    """Rows sorted by tile: for each tile, edges that span the components of the bitmap bound."""

    def spans(ids: list, sizes: list, maps: list) -> set:
        found = set()
        if len(ids) <= 6:
            as_int = [(int.from_bytes(m, "little"), len(m) * 8) for m in maps]
            for i in range(len(ids)):
                for j in range(i):
                    (x, wx), (y, wy), a, b = as_int[i], as_int[j], sizes[i], sizes[j]
                    if min(a, b) * den < max(a, b) * num:
                        continue
                    while wx > wy:
                        wx //= 2
                        x = (x & ((1 << wx) - 1)) ^ (x >> wx)
                    while wy > wx:
                        wy //= 2
                        y = (y & ((1 << wy) - 1)) ^ (y >> wy)
                    if _enough((a + b - (x ^ y).bit_count()) // 2, a, b, num, den):
                        found.add((max(ids[i], ids[j]), min(ids[i], ids[j])))
            return found
        size = np.array(sizes)
        order = np.argsort(size, kind="stable")
        ids, size = np.array(ids)[order], size[order]
        width = np.array([len(maps[k]) for k in order]) // 8
        by_width = {w: np.stack([np.frombuffer(maps[k], np.uint64) for k in order[width == w]]) for w in set(width.tolist())}
        row = np.zeros(len(ids), np.int64)
        for w in by_width:
            row[width == w] = np.arange((width == w).sum())
        left = np.ones(len(ids), bool)
        for seed in range(len(ids)):
            if not left[seed]:
                continue
            left[seed] = False
            todo = [seed]
            while todo:
                k = todo.pop()
                mine = by_width[width[k]][row[k]]
                for w, m in by_width.items():
                    who = np.flatnonzero(left & (width == w) & (size * den >= size[k] * num) & (size[k] * den >= size * num))
                    if len(who):
                        who = who[_enough(_overlap_bound(mine, size[k], m[row[who]], size[who]), size[k], size[who], num, den)]
                        left[who] = False
                        todo += who.tolist()
                        found.update((max(int(ids[k]), int(ids[j])), min(int(ids[k]), int(ids[j]))) for j in who)
        return found

    tile, ids, sizes, maps, out = None, [], [], [], set()
    for batch in it:
        for *k, i, s, m in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if k != tile:
                if len(ids) > 1:
                    out |= spans(ids, sizes, maps)
                tile, ids, sizes, maps = k, [], [], []
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_pydict({"a": [x[0] for x in out], "b": [x[1] for x in out]})
                    out = set()
            ids.append(i), sizes.append(s), maps.append(m)
    if len(ids) > 1:
        out |= spans(ids, sizes, maps)
    if out:
        yield pa.RecordBatch.from_pydict({"a": [x[0] for x in out], "b": [x[1] for x in out]})


def _tile_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """One tile: rows of block x against rows of block y. Links per row and edges that span what is linked."""
    ids, copies, block = (table.column(c).to_numpy() for c in ("class_id", "copies", "block"))
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
    size = np.array([len(s) for s in sets])
    words = bitmap_bits(int(size.max())) // 64
    maps = np.stack([parity_bitmap(s, words * 64) for s in sets])
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    links = np.zeros(len(ids), np.int64)
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    for i in left:
        other = right[right > i] if x == y else right
        other = other[(size[other] * den >= size[i] * num) & (size[i] * den >= size[other] * num)]
        if not len(other):
            continue
        other = other[_enough(_overlap_bound(maps[i], size[i], maps[other], size[other]), size[i], size[other], num, den)]
        for j in other.tolist():
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            if _enough(int((both[1:] == both[:-1]).sum()), int(size[i]), int(size[j]), num, den):
                links[i] += copies[j]
                links[j] += copies[i]
                if (p := root(i)) != (q := root(j)):
                    parent[p] = q
                    edges.append((int(ids[i]), int(ids[j])))
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array([*ids[some].tolist(), *(e[0] for e in edges)], pa.int64()), "b": pa.array([*[None] * len(some), *(e[1] for e in edges)], pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())})


def _sizes(members: DataFrame, group: str, cost: str) -> DataFrame:
    """(group, n, c, start, total, less, more): how many members of a group have each size, the cost of a group's smaller
    ones and of all, and the neighbouring sizes. Only these counts are put in order, never the members."""
    own = Window.partitionBy(group)
    by_size = own.orderBy("n")
    spent = F.expr(f"c * ({cost})")
    start = F.coalesce(F.sum(spent).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = members.groupBy(group, "n").agg(F.count("*").alias("c"))
    return counts.select(group, "n", "c", start.alias("start"), F.sum(spent).over(own).alias("total"), F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))


def _block(cost: str, block: int) -> Column:
    """The block of a member: it never falls as n rises within a group, and holds a cost of about block or one size's
    share of it. Members of one size beyond a block are dealt by hash."""
    return F.expr(f"start div {block} + pmod(xxhash64(class_id), greatest(1L, (c * ({cost}) + {block - 1}) div {block}))").cast("int")


def _tiles(members: DataFrame, group: str, num: int, den: int) -> DataFrame:
    """(group, x, y, block): each pair of blocks of compatible sizes, once for either of its blocks."""
    spans = members.groupBy(group, "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = (spans.select(group, *(F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi"))) for s in "xy")
    tiles = left.join(right, group).where(f"block_x <= block_y and hi_x * {den} >= lo_y * {num}").select(group, F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    return tiles.select("*", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))


#: What a row of n shingles costs in a tile: its hashes, and its share of comparisons.
_ROW_COST = "n + 512"


def links_of_rows(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id", n: int = 5, similarity: tuple[int, int] = (80, 100), block: int = 256, frequent_share: float = 0.0002, list_block: int = 1024, broadcast_rows: int = 100_000) -> DataFrame:
    """(row, doc_id, n_shingles, group, component_id, n_links) of every row; key has a value of its own in every row of
    docs, as row_keyed gives. group is the smallest row key that links reach.

    block is about how many rows of 512 shingles a block of a component has, list_block how many rows a block of a list.
    """
    num, den = similarity
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("row"), F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    heavy = spark.sparkContext.broadcast(frequent_shingles(docs, n, frequent_share))
    sets = shared_table(_sets(docs, n, heavy, num, den))
    heavy.destroy()
    filled = sets.where("n > 0")
    classes = shared_table(filled.groupBy("n", "f1", "f2").agg(F.min("row").alias("class_id"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))

    # Of a key's list by size, a class stays if one of the same or the neighbouring size can reach the similarity at all.
    postings = classes.select("class_id", "n", F.explode("prefix").alias("key"))
    sizes = shared_table(_sizes(postings, "key", "1").where(f"c > 1 or less * {den}L >= n * {num}L or n * {den}L >= more * {num}L").select("key", "n", "c", "start", "total"))
    marked, hit = may_be_in(postings, F.xxhash64("key", "n"), sizes.select(F.xxhash64("key", "n")))
    several = shared_table(marked.where(hit).select(*postings.columns).join(sizes, ["key", "n"]).select("key", "class_id", "n", "total", _block("1", list_block).alias("block")))
    short = several.where(F.col("total") <= list_block).select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), "class_id", "n")
    long = several.where(F.col("total") > list_block)
    long = long.join(_tiles(long, "key", num, den), ["key", "block"]).select("key", "x", "y", "class_id", "n")
    lists = short.union(long).join(classes.select("class_id", "bits"), "class_id").select("key", "x", "y", "class_id", "n", "bits")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(width, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    candidates = components(small_batches(lists).mapInArrow(lambda it: _list_edges(it, num, den), "a long, b long"))

    # The members of a candidate component by size, cut into blocks; a row goes to each tile of its block.
    members = shared_table(classes.select("class_id", "n", "copies").join(candidates.withColumnRenamed("node", "class_id"), "class_id"))
    ranked = members.join(_sizes(members, "component", _ROW_COST), ["component", "n"])
    ranked = shared_table(ranked.select(*members.columns, _block(_ROW_COST, block * 1024).alias("block")))
    tiles = _tiles(ranked, "component", num, den)
    wanted = split_by_ids(docs.select("row", "text"), ranked.select(F.col("class_id").alias("row")), "row")[0]

    def arrays(batch: pa.RecordBatch) -> dict:
        return {"class_id": batch.column(0), "shingles": pa.array([shingle_set(w, n).tobytes() for _, w in word_hashes(raw_texts(batch.column(1)))], pa.binary())}

    full = ranked.join(map_rows(wanted, arrays, "class_id long, shingles binary"), "class_id").join(tiles, ["component", "block"])
    full = full.withColumn("tile", F.concat_ws("/", "component", "x", "y"))
    found = shared_table(full.select("tile", "x", "y", "block", "class_id", "copies", "shingles").groupBy("tile").applyInArrow(lambda t: _tile_links(t, num, den), "a long, b long, links long"))

    linked = components(found.where("b is not null"))
    counts = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    named = classes.select("n", "f1", "f2", "class_id", "low", "copies").join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").join(counts, "class_id", "left")
    # Row keys are ids but for rows with a null or repeated id; only components with such rows need another name.
    other = shared_table(named.where("component is not null").groupBy("component").agg(F.min("low").alias("name")).where("not component <=> name").withColumn("other", F.lit(True)))
    few = other.count() <= broadcast_rows
    alone = named.where("component is null").select("n", "f1", "f2", F.col("class_id").alias("group"), F.col("low").alias("component_id"), "copies", "links")
    named = named.where("component is not null").join(F.broadcast(other) if few else other, "component", "left")
    named = named.select("n", "f1", "f2", F.col("component").alias("group"), F.when(F.col("other"), F.col("name")).otherwise(F.col("component")).alias("component_id"), "copies", "links")
    named = named.unionByName(alone).withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))).drop("copies", "links")
    out = filled.select("row", "doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"]).select("row", "doc_id", F.col("n").alias("n_shingles"), "group", "component_id", "n_links")
    empty = sets.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("row").alias("group"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(empty)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (80, 100), **options) -> DataFrame:
    """Links documents whose shingle sets have a Jaccard similarity of at least similarity = (num, den).

    Returns (doc_id, n_shingles, component_id, n_links): n_links counts the other rows linked directly.
    """
    keyed, key = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return links_of_rows(keyed, key, n=n, similarity=similarity, **options).select("doc_id", "n_shingles", "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked rows stays: that with the smallest id, null ids last, then with the smallest row
    key. Rows without links stay. All columns as they are."""
    keyed, key = row_keyed(docs, id_col)
    linked = shared_table(links_of_rows(keyed, key, text_col, id_col, **options).where("n_links > 0").select("row", "doc_id", "group"))
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = linked.select("row").join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return drop_ids(keyed, shared_table(gone.withColumnRenamed("row", key)), key).select(*docs.columns)
