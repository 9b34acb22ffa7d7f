"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens, served in quanta. All sources earn credit in their target proportions;
a source is served when its credit reaches half a quantum, and the rest (its deficit, which may be negative) is carried
into the next window, whichever partition works that out. A quantum divides the window, so full ones fill windows without
a cut; the short last quanta of the queues follow at the end.

The counters needn't be stepped through: quantum j of source s is served when credit for (2j + 1) / weight(s) half quanta
has come in, so what all sources have been served by then is a sum over the sources of whole numbers. Every partition
places its own quanta by that sum, without a sort, a join or a shuffle of tokens; ``deficits`` gives the counters between
any two windows. Weights are whole numbers (WEIGHT_BITS bits), so that no rounding can put two quanta in one place.

Targets default to the sources' own shares of the tokens, which empties all queues together. With other targets a
source that runs dry leaves the rest in their proportions. The QUEUES sources with the most tokens have a queue each;
those beyond share one more queue, whose weight is the sum of theirs.

Defined results: a null text is empty and still has its end token; a null source is a queue of its own; rows that repeat
are packed as often as they come; a null id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_pass, held_by_process, table, written

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
QUANTUM = 256
#: Words whose ids a task keeps.
CACHE_WORDS = 500_000
LEARN_WORDS = 300
#: Sources with a queue of their own; bits of a weight.
QUEUES, WEIGHT_BITS = 4096, 24
#: Rows of the table of places by task and source up to which it is broadcast (about 40 bytes each).
PLACES = 1_000_000

# What the vocabulary's normalizer and splitter do to texts of Latin-1 code points: such texts are in form NFC already,
# lower case is per code point, and the classes below are the letters, digits and spaces among them.
_LOW = [chr(i) for i in range(256)]
_L = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "L" and c == c.lower())
_N = "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == "N")
_S = "".join(re.escape(c) for c in _LOW if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_HELD = "\x1c"  # starts the name of a text that is encoded whole


def _byte_letters() -> dict[int, str]:
    """The code points that byte-level vocabularies write bytes as; the space stays, it parts the pieces here."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)} | {32: " "}


_LETTERS = _byte_letters()


def _lettered(text: str) -> str:
    return text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(_LETTERS)


def pieces_of(word: str) -> list[str]:
    return [word] if word.isalpha() else _SPLIT.findall(word)


class Encoder:
    """Ids of whole texts.

    No piece spans white space, so the ids of a word are kept once they are known, one after another in a pool. A batch's
    words are made distinct first; new ones are cut into pieces and go to the vocabulary's own merging model together,
    where the token that ends a piece is marked. Texts beyond Latin-1, and those with separators that Python counts as
    white space and the vocabulary doesn't, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pool = np.empty(1 << 20, self.dtype)
        self.start = np.zeros(CACHE_WORDS + 1, np.int64)  # of each word in the pool; the next word starts where it ends
        self.seen = np.zeros(CACHE_WORDS, bool)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, and how many each has."""
        ids, lengths = [], []
        parts = [[pieces_of(w) for w in words[i : i + LEARN_WORDS]] for i in range(0, len(words), LEARN_WORDS)]
        joined = [_lettered(" ".join([p for w in part for p in w])) for part in parts]
        at = 0
        for part, e in zip(parts, self.pieces.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            x = np.array(e.ids, self.dtype)
            to = np.concatenate([[0], np.flatnonzero(self.ends[x]) + 1])
            last = np.cumsum([len(w) for w in part])
            if last[-1] == len(to) - 1:
                n = np.diff(to[last], prepend=0)
            else:
                each = [self._whole(w) for w in words[at : at + len(part)]]
                x, n = np.concatenate(each), np.array([len(y) for y in each])
            ids.append(x)
            lengths.append(n)
            at += len(part)
        return np.concatenate(ids), np.concatenate(lengths)

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.words)
        start = int(self.start[n])
        while start + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[start : start + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(words)] = start + np.cumsum(lengths)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))

    def _make_room(self, more: int) -> None:
        """Only words met again since they were learned stay, if they leave enough room."""
        words, pool, start, seen = self.words, self.pool, self.start, self.seen
        self._forget()
        kept = np.flatnonzero(seen)
        if len(kept) + more > CACHE_WORDS * 3 // 4:
            return
        lengths = start[kept + 1] - start[kept]
        self._keep([w for w, i in words.items() if seen[i]], pool[_ragged(start[kept], lengths)], lengths)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids and lengths of ``new``; words that are few enough to be kept are kept."""
        base = list(dict.fromkeys([w[:-1] if w[-1] in ".,!" and w[-2:-1].isalnum() else w for w in new]))
        open_ = [w for w in base if w not in self.words]
        if len(self.words) + len(new) + len(open_) > CACHE_WORDS:
            self._make_room(len(new) + len(open_))
            open_ = [w for w in base if w not in self.words]
        if len(self.words) + len(new) + len(open_) > CACHE_WORDS:  # more than a task keeps at all
            return self._encoded(new)
        if open_:
            self._keep(open_, *self._encoded(open_))
        # a word and the sign after it: the ids of both
        ended = [w for w in new if w not in self.words]
        if ended:
            signs = [s for s in ".,!" if s not in self.words]
            if signs:
                self._keep(signs, *self._encoded(signs))
            find = self.words.__getitem__
            at = np.array([(find(w[:-1]), find(w[-1])) for w in ended], np.int64).ravel()
            lengths = self.start[at + 1] - self.start[at]
            self._keep(ended, self.pool[_ragged(self.start[at], lengths)], lengths.reshape(-1, 2).sum(axis=1))
        at = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        lengths = self.start[at + 1] - self.start[at]
        return self.pool[_ragged(self.start[at], lengths)], lengths

    @staticmethod
    def _plain(text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or "<|" in text and _SPECIAL.search(text))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        low, whole = [], []
        for t in texts:
            if self._plain(t):
                low.append(t.lower() if t.isascii() else t.lower().replace("\x85", " ").replace("\xa0", " "))
            else:
                low.append(f"{_HELD}{len(whole)}")
                whole.append(self._whole(t))
        split = pc.ascii_split_whitespace(pa.array(low, pa.string()))
        words = split.flatten()
        full = pc.not_equal(pc.binary_length(words), 0)
        named = words.filter(full).dictionary_encode()
        distinct = _strings(named.dictionary)
        # a text's number of words: those of its parts that aren't empty
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        edges = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]

        at = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        known = at >= 0
        self.seen[at[known]] = True
        lengths = np.zeros(len(distinct), np.int64)
        lengths[known] = self.start[at[known] + 1] - self.start[at[known]]
        start = np.zeros(len(distinct), np.int64)
        start[known] = self.start[at[known]]
        pool = [self.pool]  # of this batch: known words, then new ones, then texts encoded whole
        new = np.flatnonzero(~known)
        if len(new):
            held = np.array([distinct[k][0] == _HELD for k in new], bool)
            top = len(self.pool)
            if not held.all():
                some = new[~held]
                x, n = self._learn([distinct[k] for k in some])
                lengths[some], start[some] = n, top + np.cumsum(n) - n
                pool.append(x)
                top += len(x)
            for k in new[held]:
                x = whole[int(distinct[k][1:])]
                lengths[k], start[k] = len(x), top
                pool.append(x)
                top += len(x)
        index = named.indices.to_numpy()
        n = lengths[index]
        ids = (np.concatenate(pool) if len(pool) > 1 else pool[0])[_ragged(start[index], n)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[edges])


def _strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, through one string."""
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")
    return joined[0].as_py().split(" ")


def _ragged(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., lengths[0] of them; then the same for the next."""
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    return np.repeat(start - (upto - lengths), lengths) + np.arange(total)


def encoder(path: str) -> Encoder:
    return held_by_process(f"encoder {path}", lambda: Encoder(path))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


_TOKENS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("local", pa.int64()), ("ids", pa.large_binary())])


def _blob(ids: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    """The ids as bytes, a value for each of ``lengths``."""
    edges = np.concatenate([[0], np.cumsum(lengths)]) * ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])


def _tokens(docs: DataFrame, path: str | None, end_id: int) -> DataFrame:
    """Per document its ids, their number, and its place in its source's queue within the task."""

    def run(batches):
        encode = encoder(path or tokenizer_path())
        part = TaskContext.get().partitionId()
        served: dict[str | None, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            found, n = encode([t or "" for t in b.column(2).to_pylist()])
            n = n + 1
            last = np.cumsum(n) - 1
            inner = np.ones(int(last[-1]) + 1, bool)
            inner[last] = False
            ids = np.empty(len(inner), encode.dtype if end_id < 1 << 16 else np.dtype("<u4"))
            ids[inner], ids[last] = found, end_id
            sources = b.column(1).dictionary_encode(null_encoding="encode")
            local = np.zeros(len(n), np.int64)
            kind = sources.indices.to_numpy()
            for k, name in enumerate(sources.dictionary.to_pylist()):
                mine = kind == k
                upto = np.cumsum(n[mine]) + served.get(name, 0)
                local[mine] = upto - n[mine]
                served[name] = int(upto[-1])
            columns = [pa.array(np.full(len(n), part, np.int32)), b.column(0), b.column(1).cast(pa.string()), pa.array(n), pa.array(local), _blob(ids, n)]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)

    return arrow_pass(docs, run, "part int, doc_id long, source string, n long, local long, ids binary")


def quanta_before(queue: np.ndarray, j: np.ndarray, weights: list[int], full: list[int]) -> np.ndarray:
    """How many quanta of all queues are served before quantum j[i] of queue[i], which has it. Ties go to the first queue."""
    w = np.asarray(weights, np.int64)[queue]
    out = np.zeros(len(j), np.int64)
    for k, (wk, fk) in enumerate(zip(weights, full, strict=True)):
        due = (2 * j + 1) * wk - (queue < k)  # in units of 1 / (w * wk); a tie comes first only in a queue before
        out += np.where(queue == k, j, np.minimum(fk, (due // w + 1) // 2))
    return out


def deficits(served: list[int], weights: list[int]) -> list[float]:
    """The credit that each queue carries on, in quanta, after so many quanta of each were served (while none is dry)."""
    total, every = sum(served), sum(weights)
    return [total * w / every - n for n, w in zip(served, weights, strict=True)]


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.large_binary())]
)


def _pieces(rows: DataFrame, weights: list[int], full: list[int], tail_at: list[int], quantum: int, window: int) -> DataFrame:
    """rows: doc_id, source, n, o, queue, ids. Where each quantum's part of each document lies."""

    def run(batches):
        ends, tails = np.array(full, np.int64), np.array(tail_at, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            n, o, queue = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
            first = o // quantum
            many = (o + n - 1) // quantum - first + 1
            row = np.repeat(np.arange(len(n)), many)
            j = _ragged(first, many)
            at = np.maximum(o[row], j * quantum)
            length = np.minimum(o[row] + n[row], (j + 1) * quantum) - at
            tail = j == ends[queue[row]]
            place = np.empty(len(row), np.int64)
            place[~tail] = quantum * quanta_before(queue[row[~tail]], j[~tail], weights, full)
            place[tail] = tails[queue[row[tail]]]
            place += at - j * quantum
            # a short last quantum may lie across two windows
            room = window - place % window
            cut = np.flatnonzero(length > room)
            if len(cut):
                times = np.ones(len(row), np.int64)
                times[cut] = 2
                row, at, length, place = (np.repeat(x, times) for x in (row, at, length, place))
                second = cut + 1 + np.arange(len(cut))
                length[second] -= room[cut]
                length[second - 1] = room[cut]
                at[second] += room[cut]
                place[second] += room[cut]
            data = b.column(5).cast(pa.large_binary())
            edges = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            raw = np.frombuffer(data.buffers()[2], np.uint8)[edges[0] : edges[-1]]
            ids = raw.view("<u2" if len(raw) == 2 * n.sum() else "<u4").astype("<u4")
            columns = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(n[row]), pa.array(at - o[row]), pa.array(length), pa.array(place // window), pa.array(place % window), _blob(ids, length)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return arrow_pass(rows, run, "doc_id long, source string, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")


def whole_weights(tokens: list[int], given: list[float | None]) -> list[int]:
    """Weights as whole numbers: ``given`` ones in their proportions; queues without one keep their share of the tokens."""
    total = max(1, sum(tokens))
    shares = [t / total if g is None else float(g) for t, g in zip(tokens, given, strict=True)]
    if min(shares, default=1.0) < 0:
        raise ValueError("targets can't be negative")
    top = sum(shares) or 1.0
    return [max(1, round(s / top * (1 << WEIGHT_BITS))) for s in shares]


def pack_mixture(
    docs: DataFrame, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    path: str | None = None, end_id: int = END_ID, window: int = WINDOW, quantum: int = QUANTUM,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian, 32 bits each), ids_crc32, doc_tokens, sequence_id, offset, source.

    A window is the ids of its sequence_id, by offset.
    ``targets``: weight by source; a source without one keeps its own share of the tokens.
    """
    if window % quantum:
        raise ValueError("quantum has to divide window")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = written(_tokens(docs, path, end_id), compression="zstd")
    # one row for each task and source; a task's part of a queue follows those of the tasks before
    parts = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), 0)
    by_source = parts.groupBy("source").agg(F.sum("n").alias("t"))
    found = [(r["source"], r["t"]) for r in by_source.orderBy(F.desc("t"), "source").limit(QUEUES).collect()]
    all_ = by_source.agg(F.sum("t")).first()[0] or 0
    names, sizes = [s for s, _ in found], [t for _, t in found]
    given = [None if targets is None else targets.get(s) for s in names]
    if all_ > sum(sizes):  # the sources beyond the listed ones
        beyond = by_source.where(~F.coalesce(F.col("source").isin([s for s in names if s is not None]), F.lit(None in names)))
        own = {} if targets is None else {k: v for k, v in targets.items() if k not in names}
        sizes.append(all_ - sum(sizes))
        given.append(sum(r["t"] / all_ if own.get(r["source"]) is None else own[r["source"]] for r in beyond.toLocalIterator()) if own else None)
    weights = whole_weights(sizes, given)
    full = [t // quantum for t in sizes]
    order = sorted(range(len(sizes)), key=lambda k: (-weights[k], k))
    tail_at = [0] * len(sizes)
    for k, before in zip(order, accumulate([sizes[k] % quantum for k in order], initial=quantum * sum(full))):
        tail_at[k] = before

    spark = docs.sparkSession
    queues = spark.createDataFrame([(s, k) for k, s in enumerate(names)], "name string, queue int")  # QUEUES rows at most
    parts = parts.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    ahead = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    places = written(parts.select("source", "part", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("base")), 0)
    near = F.broadcast(places) if places.count() <= PLACES else places
    rows = tokens.alias("t").join(near.alias("p"), (F.col("t.part") == F.col("p.part")) & F.col("t.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("t.doc_id", "t.source", "t.n", (F.col("p.base") + F.col("t.local")).alias("o"), "p.queue", "t.ids")
    pieces = _pieces(rows, weights, full, tail_at, quantum, window)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mixture(table(spark, sf_dir, "documents")).drop("ids")  # the digests stand for them


QUERIES = {"op6_mixture_packing": op6_mixture_packing}
ORACLE: dict[str, str] = {}
