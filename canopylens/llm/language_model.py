"""Language model scores from an n-gram trie over the whole corpus.

The model is interpolated with absolute discounting: p(w | u v) = share(u v, w) + rest(u v) * p(w | v), and so on down,
where share is the discounted relative count and rest what the discount left; p(w) is the unigram estimate with half a
count added. A context that begins a text is the start and what follows it. Counts
are gathered over all training documents. Documents are handled in blocks: a block sends each of its distinct n-grams,
with its training count, to the shard of the n-gram's context; the shard adds the counts, builds its trie, and answers
the n-grams of every block from it. So neither counts nor trie ever need to fit one machine.

A block's n-grams are in the order of their context's hash, and shards are ranges of hashes. So what a shard gets from a
block is a run of that order, sent as differences of its contexts, and answers need no keys: they come back in order.

A context that would fill much of a shard is split: its n-grams go to further shards by the hash of the whole n-gram, and
what these count of the context is added up. One block, a sample of the documents by hash, tells which contexts are
split; that decides only where they are counted, so that scores don't depend on it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopylens.llm.common import cut, numbered
from canopylens.llm.elias_fano import Trie, dequantise, mapped
from canopylens.llm.jaccard_join import mix

DISCOUNT = 0.75
#: Words of the longest n-grams in production.
ORDER = 3
#: Characters of a block and of the text whose n-grams make up a shard.
BLOCK_CHARS = 8_000_000
SHARD_CHARS = 16_000_000
#: Bits that tell the contexts of one shard apart. A shard has a few million contexts at every size of the corpus, so
#: that a context meets another one's key with a chance of about 1 in 20,000.
KEY_BITS = 36
#: The end of a text is a token; its hash stands for no word. The start is a context only.
END, START = 1, 2
HELD_OUT = (5, 1)
#: A context is split if a block has more n-grams of it than this share of a block's, divided by the number of shards, and
#: at least so many; of more than MOST contexts of a level, those with the most.
SPLIT_SHARE = 1 / 8
SPLIT_LEAST = 16
SPLIT_MOST = 10_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the checksum of its id, as text, modulo 5 is 1. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


class Block:
    """Tokens of some documents and their distinct n-grams, in an order that the rows' order doesn't change."""

    def __init__(self, texts: list[str | None], learn: np.ndarray, length: int):
        ids: dict[bytes, int] = {}
        words: list[int] = []
        self.lengths = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = (t or "").encode().lower().split()
            words += [ids.setdefault(w, len(ids)) for w in own]
            words.append(-1)
            self.lengths[k] = len(own) + 1
        local = np.array(words, np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids] + [END], np.uint64)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.token = rank[local]
        begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        learnt = np.repeat(learn, self.lengths)
        self.token_n = np.bincount(self.token, learnt, len(order)).astype(np.int64)
        #: Of each level from 2: the n-gram of each token, and of each n-gram the hash of its context and of its word, and
        #: its count; n-grams in order of the contexts' hashes, then the words'.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shorter, names = self.token, self.hashes
        for level in range(2, length + 1):
            before = np.concatenate([[0], shorter[:-1] + 1])
            before[begins] = 0
            gram, of = np.unique(before * len(order) + self.token, return_inverse=True)
            place, word = np.divmod(gram, max(1, len(order)))
            context, word = np.concatenate([np.array([START], np.uint64), names])[place], self.hashes[word]
            self.levels.append((of, context, word, np.bincount(of, learnt, len(gram)).astype(np.int64)))
            if level < length:
                names = mix(context * np.uint64(0x9E3779B97F4A7C15) + word)
                by_name = np.argsort(names, kind="stable")
                at = np.empty(len(names), np.int64)
                at[by_name] = np.arange(len(names))
                shorter, names = at[of], names[by_name]


def shard_and_key(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole part of hash * shards / 2**64, and KEY_BITS of the fraction; both grow with the hash."""
    half, mask, n = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(shards)
    low = (hashes & mask) * n
    high = (hashes >> half) * n + (low >> half)
    return (high >> half).astype(np.int64), ((high & mask) << half | low & mask) >> np.uint64(64 - KEY_BITS)


def shut(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their first, second, ... bytes."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def opened(blob: bytes, kind: type) -> np.ndarray:
    """The numbers of shut()."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where another value begins in any of the columns, and their end."""
    n = len(columns[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def dealt(context: np.ndarray, word: np.ndarray, split: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the n-grams whose context isn't split; of the others, by part: places, part, place of the context in split.

    All are in the n-grams' order, within a part.
    """
    first = starts(context)
    at = np.searchsorted(split, context[first[:-1]])
    here = np.append(split, np.uint64(0))[at] == context[first[:-1]]
    of = np.repeat(np.where(here & (at < len(split)), at, -1), np.diff(first))
    mine = np.flatnonzero(of >= 0)
    part = ((mix(context[mine] * np.uint64(0x9E3779B97F4A7C15) + word[mine]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.flatnonzero(of < 0), mine[order], part[order], of[mine[order]]


def _texts(rows: pa.Table) -> tuple[list, list]:
    """Documents of the packed rows of a block."""
    ids, texts = [], []
    for blob in rows.column("blob").to_pylist():
        t = pa.ipc.open_stream(blob).read_all()
        ids += t.column(0).to_pylist()
        texts += t.column(1).to_pylist()
    return ids, texts


def _learn(ids: list) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % HELD_OUT[0] != HELD_OUT[1] for i in ids], bool)


def in_blocks(docs: DataFrame, blocks: int, only: int | None = None) -> DataFrame:
    """(block, blob): documents of a task that share a block, compressed; of one block only, if that is given.

    docs: (doc_id, text, _row) of numbered(), so that rows that repeat are dealt to all blocks as others are.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches:
            block = batch.column("block").to_numpy()
            out = []
            for b in np.unique(block):
                part = pa.Table.from_batches([batch]).select(["doc_id", "text"]).take(np.flatnonzero(block == b))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_table(part)
                out.append(sink.getvalue().to_pybytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(block), pa.int64()), pa.array(out, pa.binary())], names=["block", "blob"])

    rows = docs.select("doc_id", "text", F.pmod("_row", F.lit(blocks)).alias("block"))
    return (rows if only is None else rows.where(F.col("block") == only)).mapInArrow(pack, "block long, blob binary")


def split_contexts(block: DataFrame, shards: int, order: int) -> dict[int, tuple[np.ndarray, int]]:
    """For each level from 2 the contexts that are split, in order of their hashes, and into how many parts, from one block."""

    def most(rows: pa.Table) -> pa.Table:
        ids, texts = _texts(rows)
        out = []
        for level, (_, context, *_) in enumerate(Block(texts, _learn(ids), order).levels, 2):
            first = starts(context)
            n = np.diff(first)
            chosen = np.argsort(-n, kind="stable")[:SPLIT_MOST]
            chosen = chosen[n[chosen] >= max(SPLIT_LEAST, SPLIT_SHARE * len(context) / shards)]
            loads = math.ceil(n[chosen].sum() * shards / max(1, len(context)))
            out.append((level, np.sort(context[first[chosen]]).tobytes(), loads))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["level", "contexts", "parts"])

    found = block.groupBy("block").applyInArrow(most, "level int, contexts binary, parts long").collect() if order > 1 else []
    none = {level: (np.zeros(0, np.uint64), 1) for level in range(2, order + 1)}
    return none | {r.level: (np.frombuffer(r.contexts, np.uint64), max(1, r.parts)) for r in found}


def lookups(blocks: DataFrame, shards: int, discount: float, order: int, split: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """(block, level, shard, a, b): what the shards answer each block, one byte or number for each n-gram sent, in order.

    Both are compressed. Level 1: a has the training counts of the words. From level 2: a and b have the codes of share and
    rest. Shards below 0 are the parts of split contexts: a has the codes of the share of what the part counts of the
    context, and b that number. Rows of block -1 have in total the training tokens of a shard and in kinds its distinct
    ones, for a part those of each split context, context being its place.
    """
    sent = "block long, level int, shard long, contexts binary, runs binary, words binary, counts binary"

    def send(rows: pa.Table) -> pa.Table:
        ids, texts = _texts(rows)
        out = []

        def put(level: int, to: np.ndarray, key: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
            edges = starts(to)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                first = starts(key[a:b])
                keys = shut(np.diff(key[a:b][first[:-1]], prepend=np.uint64(0)))
                runs, words = (shut(np.diff(first).astype(np.uint32)), word[a:b].tobytes()) if level > 1 else (b"", b"")
                out.append((rows.column("block")[0].as_py(), level, int(to[a]), keys, runs, words, shut(n[a:b].astype(np.uint32))))

        block = Block(texts, _learn(ids), order)
        put(1, *shard_and_key(block.hashes, shards), block.hashes, block.token_n)
        for level, (_, context, word, n) in enumerate(block.levels, 2):
            short = (word >> np.uint64(32)).astype(np.uint32)
            plain, mine, part, of = dealt(context, word, *split[level])
            put(level, *shard_and_key(context[plain], shards), short[plain], n[plain])
            put(level, -1 - part, of.astype(np.uint64), short[mine], n[mine])
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "level", "shard", "contexts", "runs", "words", "counts"])

    answered = "block long, level int, shard long, a binary, b binary, context long, total long, kinds long"

    def answer(rows: pa.Table) -> pa.Table:
        level, shard = rows.column("level")[0].as_py(), rows.column("shard")[0].as_py()
        asking = rows.column("block").to_pylist()
        counts = [opened(n, np.uint32) for n in rows.column("counts").to_pylist()]
        names, of = np.unique(np.concatenate([np.cumsum(opened(c, np.uint64)) for c in rows.column("contexts").to_pylist()]), return_inverse=True)
        if level > 1:
            runs = np.concatenate([opened(r, np.uint32) for r in rows.column("runs").to_pylist()])
            word = np.concatenate([np.frombuffer(w, np.uint32) for w in rows.column("words").to_pylist()])
            gram, of = np.unique(np.repeat(of.astype(np.uint64) << np.uint64(32), runs) | word, return_inverse=True)
        else:
            gram = names
        m = np.bincount(of, np.concatenate(counts), len(gram)).astype(np.int64)
        seen = m > 0
        if level == 1:
            a, b = m.astype(np.uint32), np.zeros(len(m), np.uint8)
        else:
            context, word = names[gram >> np.uint64(32)], (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            with mapped(Trie.of(context[seen], word[seen], m[seen], discount)) as trie:
                a, b = trie.query(context, word)
        sums = []
        if level == 1:
            sums = [(0, int(m.sum()), int(seen.sum()))]
        elif shard < 0:
            at = (gram >> np.uint64(32)).astype(np.int64)
            total, kinds = (np.bincount(at, x, len(names)).astype(np.int64) for x in (m, seen))
            b = total[at]
            sums = list(zip(names.tolist(), total.tolist(), kinds.tolist(), strict=True))
        a, b = a[of], b[of]
        ends = np.cumsum([len(n) for n in counts])[:-1]
        out = [(k, level, shard, shut(x), shut(y), 0, 0, 0) for k, x, y in zip(asking, np.split(a, ends), np.split(b, ends), strict=True)]
        out += [(-1, level, shard, b"", b"", *x) for x in sums]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), types, strict=True)], names=["block", "level", "shard", "a", "b", "context", "total", "kinds"])

    return blocks.groupBy("block").applyInArrow(send, sent).groupBy("level", "shard").applyInArrow(answer, answered)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", discount: float = DISCOUNT, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Training documents are those that held_out() lets through; all documents are scored, from their whole texts. A null
    or empty text is one token, the end. Repeated rows each count and are each scored. Words unseen in training get half
    a count. order is the number of words of the longest n-grams. Other columns are left out. An empty table gives an empty table.
    """
    chars = docs.agg(F.sum(F.length(text) + 1)).first()[0] or 0
    blocks, shards = max(1, math.ceil(chars / BLOCK_CHARS)), max(1, math.ceil(chars / SHARD_CHARS))
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    packed = in_blocks(rows, blocks)
    split = split_contexts(in_blocks(rows, blocks, only=0), shards, order)
    answers = cut(lookups(packed, shards, discount, order, split), "lm-answers")
    sums = answers.where("block = -1").groupBy("level", "context").agg(F.sum("total").alias("n"), F.sum("kinds").alias("v"))
    known = sums.where("level = 1").agg(F.max("n").alias("n"), F.max("v").alias("v")).first()
    of_split = {level: np.zeros((2, len(names)), np.int64) for level, (names, _) in split.items()}
    for r in sums.where("level > 1").collect():  # at most SPLIT_MOST for each level
        of_split[r.level][:, r.context] = r.n, r.v
    n_train, z = known.n or 0, (known.n or 0) + 0.5 * ((known.v or 0) + 1)

    def scored(rows: pa.Table, got: pa.Table) -> pa.Table:
        ids, texts = _texts(rows)
        learn = _learn(ids)
        block = Block(texts, learn, order)
        back = sorted(zip(*(got.column(c).to_pylist() for c in ("level", "shard", "a", "b")), strict=True))

        def answers_of(level: int, parts: bool, column: int, kind: type) -> np.ndarray:
            ours = [r[column] for r in back if r[0] == level and (r[1] < 0) == parts]
            return np.concatenate([opened(x, kind) for x in (reversed(ours) if parts else ours)]) if ours else np.zeros(0, kind)

        count = answers_of(1, False, 2, np.uint32)
        unigram = (count + 0.5) / z
        p, of = unigram, block.token
        for level, (gram_of, context, word, _) in enumerate(block.levels, 2):
            plain, mine, _, place = dealt(context, word, *split[level])
            share, rest = np.empty(len(context)), np.empty(len(context))
            share[plain], rest[plain] = (dequantise(answers_of(level, False, c, np.uint8)) for c in (2, 3))
            total, kinds = of_split[level][:, place]
            share[mine] = dequantise(answers_of(level, True, 2, np.uint8)) * answers_of(level, True, 3, np.int64) / np.maximum(total, 1)
            rest[mine] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            shorter = np.empty(len(context), np.int64)
            shorter[gram_of] = of
            p, of = share + rest * p[shorter], gram_of
        edges = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
        add = lambda per_token: np.add.reduceat(per_token, edges)
        columns = [pa.array(ids, pa.int64()), pa.array(~learn), pa.array(block.lengths), pa.array(add((count[block.token] > 0).astype(np.int64))), pa.array(np.full(len(ids), n_train, np.int64)), pa.array(add(np.log10(unigram)[block.token])), pa.array(add(np.log10(p)[of]))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.where("block >= 0").select("block", "level", "shard", "a", "b")
    return packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scored, schema)
