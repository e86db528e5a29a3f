"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The plan works on counts by length, a table of at most ``capacity`` numbers, so
it costs the same for any number of documents. Exact complements come first:
sums of one, two and three lengths are indexed, and combinations that fill a gap
exactly are consumed in bulk under the counts that are left. What remains is
packed best-fit. Pieces then take their places by their rank within their
length, which two small aggregations number without sorting all pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, shuffle_partitions, written

CAPACITY = 2048
#: Words whose ids a Python worker remembers; a million takes some 350 MB.
REMEMBER = 2_000_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Words:
    """Token ids of texts, each word encoded once.

    A byte-level BPE never joins across a single space or line feed that stands
    between two other characters: the space goes with the word after it, the line
    feed is a token of its own. A word of letters, with or without a mark after it,
    is one piece for the model (and the mark another). Texts with other white
    space, and texts that hold the string of a special token, are encoded whole.
    """

    _MARKS = frozenset(".,;:!?")
    #: White space that makes a text irregular; so does a space or line feed beside another, or at an end.
    _OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
    _BESIDE = ("  ", " \n", "\n ", "\n\n")

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self.ids: dict[str, bytes] = {}
        self.remember = remember
        probe = "One two, three.\nFour 5 six's \u00c0 c\u00f4t\u00e9! naïve; Ünder? a1b 'tis ... x"
        self.split = self._joined(self._units(probe)) == self._encode([probe])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _units(text: str) -> list[str]:
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _piece(self, piece: str) -> bytes:
        found = self.ids.get(piece)
        if found is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            found = self.ids[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def _learn(self, units: set[str]) -> None:
        if len(self.ids) > self.remember:
            self.ids.clear()
        rest = []
        for u in [x for x in units if x not in self.ids]:
            word, mark = (u[:-1], u[-1]) if u and u[-1] in self._MARKS else (u, "")
            if word.removeprefix(" ").isalpha():
                self.ids[u] = self._piece(word) + self._piece(mark) if mark else self._piece(word)
            else:
                rest.append(u)
        self.ids.update(zip(rest, self._encode(rest), strict=True))

    def _joined(self, units: list[str]) -> bytes:
        self._learn(set(units))
        return b"".join(map(self.ids.__getitem__, units))

    def _odd(self, text: str) -> bool:
        if not text or not self.split or "\0" in text or text[0] in " \n" or text[-1] in " \n":
            return True
        return any(x in text for x in self._BESIDE) or any(x in text for x in self._OTHER) or any(x in text for x in self.special)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._odd(t)]
        plain = sorted(set(range(len(texts))) - set(whole))
        units = [self._units(texts[i]) for i in plain]
        need: set[str] = set()
        for u in units:
            need.update(u)
        self._learn(need)
        for i, u in zip(plain, units, strict=True):
            out[i] = b"".join(map(self.ids.__getitem__, u))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def _words(path: str, remember: int) -> _Words:
    return _Words(path, remember)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian uint32 bytes).

    The end id closes each document. Longer ones are cut into pieces of the full
    capacity; the first piece is what is over.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        encode = _words(tokenizer, remember)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[list] = [[] for _ in names]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, found in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    found += end
                    n, start, number = len(found) // 4, 0, 0
                    length = n % capacity or min(n, capacity)
                    while start < n:
                        cut = found[4 * start : 4 * (start + length)]
                        for column, x in zip(rows, (doc, number, start, length, zlib.crc32(cut), cut), strict=False):
                            column.append(x)
                        start, length, number = start + length, capacity, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names)
        encode.ids.clear()  # the worker stays, and has other work next
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, PIECE + ", ids binary" * ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that it fills."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns: dict[tuple[int, ...], int] = defaultdict(int)

    def take(combo: tuple[int, ...]) -> None:
        need = np.bincount(combo, minlength=capacity + 1)
        used = np.flatnonzero(need)
        n = int((left[used] // need[used]).min())
        if n:
            left[used] -= n * need[used]
            patterns[combo] += n

    take((capacity,))
    # pair sums that may still be there; an entry goes when no such pair is left
    has = left > 0
    sums = np.zeros(capacity + 1, bool)
    lengths = np.flatnonzero(has)
    for a in lengths:
        sums[a + lengths[lengths <= capacity - a]] = True

    def pair(gap: int, fits) -> tuple[int, int] | None:
        a = np.arange((gap + 1) // 2, gap)
        for x in a[(left[a] > 0) & (left[gap - a] > 0)][::-1].tolist():
            if fits((x, gap - x)):
                return x, gap - x
        sums[gap] = sums[gap] and bool(((left[a] > 0) & (left[gap - a] > 0)).any())
        return None

    for length in range(capacity - 1, 0, -1):
        if not left[length]:
            continue
        gap = capacity - length

        def fits(rest: tuple[int, ...], length=length) -> bool:
            need: dict[int, int] = defaultdict(int)
            for x in (length, *rest):
                need[x] += 1
            return all(left[x] >= n for x, n in need.items())

        if fits((gap,)):  # one length fills the gap
            take((length, gap))
        while left[length] and sums[gap] and (two := pair(gap, fits)):
            take((length, *two))
        if left[length] and gap >= 3:
            third = np.arange(gap - 2, 0, -1)
            for c in third[(left[third] > 0) & sums[gap - third]].tolist():
                while left[length] and left[c] and (two := pair(gap - c, lambda r, c=c: fits((c, *r)))):
                    take((length, c, *two))
                if not left[length]:
                    break
    # best fit: the longest first, each into the smallest gap that holds it
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity + 1) if open_.get(g)), None)
            if gap is None:
                fill = capacity // length
                bins, rest = divmod(n, fill)
                for items, many in ((fill, bins), (rest, 1)):
                    if items and many:
                        room = capacity - items * length
                        combo = (length,) * items
                        open_[room][combo] = open_[room].get(combo, 0) + many
                n = 0
                continue
            combo, many = next(iter(open_[gap].items()))
            used = min(n, many)
            if many == used:
                del open_[gap][combo]
            else:
                open_[gap][combo] = many - used
            more = (*combo, length)
            open_[gap - length][more] = open_[gap - length].get(more, 0) + used
            n -= used
    for found in open_.values():
        for combo, many in found.items():
            patterns[combo] += many
    return [(c, n) for c, n in patterns.items() if n]


def _slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, intervals of ranks: where they begin, the first sequence, the offset."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for combo, n in found:
        offset = 0
        for length in combo:
            rows[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def best_fit_packing(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, ids: bool = True, remember: int = REMEMBER) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32``, then
    ``ids`` if asked for, ``sequence_id`` and ``offset``. A null or empty text is
    its end id alone. Repeated rows and null ids are documents like any other. An
    empty table gives an empty result; other columns are ignored. Only the counts
    by length, at most ``capacity`` numbers, reach the driver.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    cut = written(pieces(columns(docs, id_col, text_col).toDF("doc_id", "text"), tokenizer, capacity=capacity, end_id=end_id, ids=ids, remember=remember))
    # ranks within a length: the place in a group of hashed ids after all earlier groups' counts
    groups = max(64, 4 * shuffle_partitions(docs.sparkSession))
    keyed = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = keyed.groupBy("length", "g").count()
    slots = _slots(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(base, ["length", "g"]).withColumn("rank", F.col("rank") + F.col("base"))
    keep = cut.columns

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                begins, first, where = slots[int(length[at[0]])]
                i = np.searchsorted(begins, rank[at], side="right") - 1
                sequence[at], offset[at] = first[i] + rank[at] - begins[i], where[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "rank").mapInArrow(place, PIECE + ", ids binary" * ids + ", sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    found = best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
