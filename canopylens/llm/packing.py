"""Best-fit packing of token sequences with certified bin counts.

Pieces are dealt to partitions and packed there by best-fit decreasing. A lower bound from dual feasible functions tells
how many bins a partition needs at least; one that reached it is certified, and all its bins but the emptiest are final.
Partitions with a gap keep their full bins only. The documents of the other bins go to an exchange, are dealt anew, to
fewer partitions, and packed again.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopylens.llm.common import cut, keep

CAPACITY = 2048
#: Pieces that one task packs, and rounds of exchange.
PARTITION_PIECES = 50_000
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of words as bytes, each word tokenised once for as long as it is remembered.

    The tokenizer drops white space, never joins across it, and splits letters from punctuation; the last token of each
    such part ends in END_OF_WORD. So all new words of letters are tokenised in one call and told apart by that mark.
    """

    END_OF_WORD = "</w>"
    MOST = 800_000
    #: What may follow the letters of a word and then is a part of its own.
    TAIL = ".,;:!?*#$%&|()"

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(self.END_OF_WORD)]] = True
        self.ids: dict[str, bytes] = {"": b""}
        # for words of ASCII letters in lower case the same model needs no normalizer and only white space to split at
        self.light = Tokenizer.from_file(vocabulary)
        self.light.normalizer, self.light.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        probe = " ".join(sorted({w.removesuffix(self.END_OF_WORD) for w in vocab if w.removesuffix(self.END_OF_WORD).isalpha() and w.isascii() and w.islower()})[:5000])
        if self._encode(probe).tolist() != self.light.encode(probe, add_special_tokens=False).ids:
            self.light = self.tokenizer

    @classmethod
    def of(cls, vocabulary: str) -> WordIds:
        """One for each worker process, while it packs."""
        return keep(f"words of {vocabulary}", lambda: cls(vocabulary))

    def _encode(self, text: str, light: bool = False) -> np.ndarray:
        tokenizer = self.light if light else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[str], light: bool) -> None:
        """Remember the ids of words of letters, some thousand in a call."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            found = self._encode(" ".join(some), light)
            cuts = [0, *((np.flatnonzero(self.ends[found]) + 1) * 4).tolist()]
            if len(cuts) == len(some) + 1:
                raw = found.tobytes()
                self.ids.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
            else:
                self.ids.update((w, self._encode(w).tobytes()) for w in some)

    def _split(self, word: str) -> tuple[str, str]:
        """The letters of a word and the punctuation after them; none for words of another form.

        A letter whose lower case holds a mark is of another form: the tokenizer joins the mark with what follows.
        """
        base = word.rstrip(self.TAIL)
        if base.isascii():
            return (base.lower(), word[len(base) :]) if base.isalpha() else ("", "")
        plain = base.isalpha() and is_normalized("NFC", base) and base.lower().isalpha()
        return (base, word[len(base) :]) if plain else ("", "")

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words; of those, words of letters are tokenised together."""
        if len(self.ids) > self.MOST:
            self.ids = {"": b""}
        ids = self.ids
        new = {w: self._split(w) for w in words.difference(ids)}
        bases = {base for base, _ in new.values()}.difference(ids)
        for w in {tail for _, tail in new.values()}.difference(ids):
            ids[w] = self._encode(w).tobytes()
        self._encode_words([w for w in bases if w.isascii()], True)
        self._encode_words([w for w in bases if w and not w.isascii()], False)
        for w, (base, tail) in new.items():
            ids[w] = ids[base] + ids[tail] if base else self._encode(w).tobytes()

    def streams(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and a final id 0, cut every capacity tokens.

    A null text is empty: one piece of the id 0. Null ids and repeated rows are documents of their own.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.of(vocabulary)
        end = np.array([0], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for key, stream in zip(batch.column(0).to_pylist(), ids.streams(batch.column(1).to_pylist()), strict=True):
                    stream += end
                    for k, start in enumerate(range(0, len(stream), capacity * 4)):
                        part = stream[start : start + capacity * 4]
                        out.append((key, k, start // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(k)
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left := room - size:
            if not open_bins.setdefault(left, []):
                insort(rooms, left)
            open_bins[left].append(b)
    return bins, offsets, len(used)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the bounds from dual feasible functions.

    u_k maps x to floor((k+1)x)/k, or x itself where (k+1)x is whole; the threshold functions map sizes over 1-e to 1,
    those under e to 0 and keep the rest. The sum of the images never exceeds the number of bins.
    """
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True)
    best = math.ceil(int((size * n).sum()) / capacity)
    for k in range(1, 40):
        scaled = size * (k + 1)
        image = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((image * n).sum()) // (capacity * k)))
    for e in np.unique(np.minimum(size, capacity - size))[:: max(1, len(size) // 200)]:
        if 0 < e <= capacity // 2:
            image = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
            best = max(best, -(-int((image * n).sum()) // capacity))
    return best


def _round(todo: DataFrame, number: int, rows: int, last: bool, capacity: int) -> DataFrame:
    """One packing of todo: rows with their bin, and final where they may stay in it."""
    parts = max(1, math.ceil(rows / PARTITION_PIECES))
    dealt = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(number)), F.lit(parts)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        fill = np.bincount(bins, lengths, n_bins)
        stays = fill[bins] == capacity if n_bins > bound else bins != fill.argmin()
        return pdf.assign(sequence_id=(number << 56) + pdf["part"].astype("int64") * (1 << 24) + bins, offset=offsets, final=stays | last, part_bins=n_bins, part_bound=bound)

    schema = f"{PIECES}, part int, sequence_id long, offset long, final boolean, part_bins long, part_bound long"
    return dealt.groupBy("part").applyInPandas(pack, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset, and the bins and the bound of the partition that placed them.

    No piece is longer than capacity. Ties in length go by doc_id and piece; equal pieces may swap places. A full
    piece is a sequence of its own. An empty table gives an empty table.
    """
    pieces = cut(pieces, "pieces")
    placed = ["sequence_id", "offset", "part_bins", "part_bound"]
    whole = pieces.where(F.col("length") == capacity).select("*", F.xxhash64("doc_id", "piece", "start", "ids_crc32").alias("_h"))
    done = whole.select(*pieces.columns, (F.lit((rounds + 1) << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound"))
    todo = pieces.where(F.col("length") < capacity)
    for number in range(1, rounds + 1):
        rows = todo.count()
        last = number == rounds or rows <= PARTITION_PIECES
        packed = cut(_round(todo, number, rows, last, capacity), f"packed{number}")
        done = done.unionByName(packed.where("final").select(*pieces.columns, *placed))
        if last:
            break
        todo = packed.where("not final").select(*pieces.columns)
    return done


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Where each piece of each document lies."""
    return pack(tokenize(docs, vocabulary)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> Column:
    """Share of the sequences' room that holds tokens."""
    return packed.agg((F.sum("length") / (F.countDistinct("sequence_id") * capacity)).alias("fill"))
