"""Packing: documents into fixed-length token sequences by shortest-pack-first over the length histogram.

Plan
 1. A mapper tokenises every text and cuts it into pieces: full windows of the sequence length, then the rest. It
    returns lengths and checksums only; token ids stay in the mapper.
 2. The histogram of rest lengths (at most sequence-length rows, whatever the input) goes to the driver, which
    places lengths longest first, each into the pattern with the most room left among those it fits, splitting
    pattern counts as it goes. The result is a list of packing patterns with counts.
 3. Every pattern slot covers a range of ranks of its length. Pieces get a rank within their length in two steps
    (a count per salt, then a rank within the salt, so that a frequent length is dealt over many tasks) and join
    the slot ranges by an equi-join on (length, rank bucket).

Results: one row per piece. A null or empty text has only the end id, so every row of the input has a piece.
Repeated rows have pieces of their own. Ties in rank are broken by id and start.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_table
from .common import map_rows, raw_texts

SEQUENCE = 2048
#: Characters for which the pre-tokeniser's pattern, NFC and lower-casing are known to act letter by letter; texts
#: with any other character, or with the opening of a special token, go through the tokeniser as a whole.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Entries of the two caches of a worker. A full cache is not extended: what came first is mostly what is frequent.
_CACHE_CHUNKS, _CACHE_WORDS = 250_000, 400_000


def _byte_letters() -> dict[int, str]:
    """Code point below 256 to the letters that stand for its UTF-8 bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 up, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, from bounded caches of the ids of blank-separated
    chunks and of the words and punctuation in them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        words, tokens, letters, out, rare = self.words, self.model.tokenize, self.letters, {}, {}
        for c in chunks:
            split = _WORD.findall(c)
            got = []
            for w in split:
                ids = words.get(w) or rare.get(w)
                if ids is None:
                    ids = array("I", [t.id for t in tokens(w.translate(letters))]).tobytes()
                    (words if len(words) < _CACHE_WORDS else rare)[w] = ids
                got.append(ids)
            out[c] = got[0] if len(got) == 1 else b"".join(got)
        if len(self.chunks) < _CACHE_CHUNKS:
            self.chunks.update(out)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out, late, new = self.chunks.get, [], [], set()
        for t in texts:
            if not t.isascii() and _OTHER.search(t) or "<|" in t or _CONTROL.search(t):
                out.append(np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            split = t.lower().split()
            found = list(map(get, split))
            if None in found:
                new.update(w for w, f in zip(split, found) if f is None)
                late.append((len(out), split, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        fresh = self._encode_chunks(new)
        for at, split, found in late:
            out[at] = b"".join([fresh[w] if f is None else f for w, f in zip(split, found)])
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of all documents, cut at multiples of sequence."""

    def run(batch: pa.RecordBatch) -> dict:
        enc, end, size = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * sequence
        ids, texts = batch.column(0).to_pylist(), [t.decode("utf-8", "replace") for t in raw_texts(batch.column(1))]
        doc, start, length, crc, total = [], [], [], [], []
        for low in range(0, len(ids), 200):
            for i, raw in zip(ids[low : low + 200], enc.encode(texts[low : low + 200])):
                raw += end
                for at in range(0, len(raw), size):
                    piece = raw[at : at + size]
                    doc.append(i), start.append(at // 4), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(raw) // 4)
        return {"doc_id": pa.array(doc, pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}}

    def forget() -> None:
        encoder(tokenizer_path).chunks.clear()
        encoder(tokenizer_path).words.clear()

    return map_rows(docs, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", after=forget)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used: lengths from longest to shortest, each into the shortest pack.

    Works on counts: a length that occurs c times opens or extends patterns in blocks, so the time depends on the
    number of distinct lengths and patterns, not on the number of pieces.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], count: int, free: int) -> None:
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append((pattern, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # Nothing has room: new packs, opened one after the other, so each takes as many as it holds.
                each = sequence // length
                if left >= each:
                    put((length,) * each, left // each, sequence - length * each)
                if left % each:
                    put((length,) * (left % each), 1, sequence - length * (left % each))
                break
            free = rooms[-1]
            pattern, count = room[free].pop()
            if not room[free]:
                del room[free]
                del rooms[bisect_left(rooms, free)]
            used = min(count, left)
            if used < count:
                put(pattern, count - used, free)
            put((*pattern, length), used, free - length)
            left -= used
    return [x for free in rooms for x in room[free]]


def _slots(patterns: list[tuple[tuple[int, ...], int]], bucket: int) -> list[tuple]:
    """Rank ranges: (length, bucket, first rank, end rank, sequence of the first rank, offset); a sequence has each slot once."""
    rows, seen, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            first = seen.get(length, 0)
            for b in range(first // bucket, (first + count - 1) // bucket + 1):
                low, high = max(first, b * bucket), min(first + count, (b + 1) * bucket)
                rows.append((length, b, low, high, sequence + low - first, offset))
            seen[length] = first + count
            offset += length
        sequence += count
    return rows


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds rank: 0, 1, ... within each length. No task holds a whole length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    salted.createOrReplaceTempView("fathomgrid_pieces")
    spark = pieces.sparkSession
    base = spark.sql("select length, salt, sum(c) over (partition by length order by salt) - c as base from (select length, salt, count(*) c from fathomgrid_pieces group by length, salt)")
    within = spark.sql("select *, row_number() over (partition by length, salt order by doc_id, start) - 1 as within from fathomgrid_pieces")
    out = within.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "base", "within")
    spark.catalog.dropTempView("fathomgrid_pieces")
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, sequence: int = SEQUENCE, salts: int = 64, bucket: int = 1 << 16) -> DataFrame:
    """Packs all documents; returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = shared_table(token_pieces(docs, tokenizer_path, end_id, sequence))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    spark = docs.sparkSession
    patterns = shortest_pack_first({n: c for n, c in counts.items() if n < sequence}, sequence)
    rows = _slots([*patterns, ((sequence,), counts[sequence])] if counts.get(sequence) else patterns, bucket)
    slots = spark.createDataFrame(rows, "length long, bucket long, low long, high long, first long, offset long")
    placed = _ranked(pieces, salts).withColumn("bucket", F.expr(f"rank div {bucket}")).join(slots, ["length", "bucket"]).where("rank >= low and rank < high")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
