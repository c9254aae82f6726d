"""Token ids in grammar-compressed binary files.

File format (little endian). Header ``HEAD``: magic, documents, rules, symbols, vocabulary, id width
in bytes. Then doc_id int64, symbols uint32 and tokens uint32 of each document; left and right symbol
uint32 and expansion length uint32 of each rule; then the symbols. Symbol ``vocabulary + k`` stands for
rule ``k``, whose two parts are ids or earlier rules. No rule crosses a document's end, so document
``d`` is the symbols between two sums of the symbol counts, and the expansion lengths tell which of
them hold a wanted token without expanding the rest (``read_tokens``).
"""

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, shared_dir, text_chunks, write_table

HEAD = struct.Struct("<8sIIQII")
MAGIC = b"TMGRAM01"
END = 0
#: Ids in a file, more or less: a file holds whole documents.
FILE_TOKENS = 1_000_000
#: Occurrences from which a pair counts as frequent; a rule takes the place of six symbols itself.
MIN_COUNT = 32
#: Stretches of text whose ids a worker remembers (some 20 MB), and bytes that a stretch can have for that.
WORDS, LANES = 1 << 19, 3
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 21

_U = np.uint64
_DIGIT, _LETTER, _GRAPHIC, _BLANK = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = _GRAPHIC[33:127] = True
_BLANK[[10, 32]] = True
#: Letters of Latin-1, as bytes: a lead byte C3 and one more.
_LATIN = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
_SECOND = np.zeros(256, bool)
_SECOND[[ord(c) - 0x40 for c in _LATIN]] = True
PLAIN = re.compile(f" ?[A-Za-z{''.join(_LATIN)}]+").fullmatch


def cuts(b: np.ndarray) -> np.ndarray:
    """Places at which the tokenizer's own pattern always begins a new part, so that the stretches between can be encoded one by one.

    These are the starts of white space after a letter, digit or mark, of a digit or mark after a letter, of
    anything else after a digit, of a letter or digit after a mark (an apostrophe may begin a contraction,
    and is none here), and what follows a lone line break. Only ASCII and the letters of Latin-1 are told apart: elsewhere there is no cut.
    """
    cont = np.r_[False, (b[:-1] == 0xC3) & _SECOND[b[1:]]] if len(b) else np.zeros(0, bool)
    letter, digit, graphic = _LETTER[b], _DIGIT[b], _GRAPHIC[b]
    lead = np.r_[cont[1:], False] if len(b) else cont
    mark = graphic & ~letter & ~digit
    first, last = letter | lead, letter | cont  # of a letter's bytes
    begins, ends = graphic | lead, graphic | cont
    out = np.zeros(len(b), bool)
    out[1:] = ends[:-1] & _BLANK[b[1:]]
    out[1:] |= last[:-1] & (mark | digit)[1:]
    out[1:] |= digit[:-1] & (mark | first)[1:]
    out[1:] |= (mark & (b != 0x27))[:-1] & (first | digit)[1:]
    out[2:] |= ends[:-2] & (b[1:-1] == 10) & begins[2:]
    return out


MIXER = _U(0x9E3779B97F4A7C15)
#: The lowest n bytes of a whole number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


class Encoder:
    """Ids of texts from a byte-level tokenizer file. A stretch between cuts is encoded once, and remembered while there is room.

    Stretches of up to 23 bytes are their own key (their bytes and length), so different ones never meet.
    Those of letters alone go to the tokenizer's model, others through the whole tokenizer, and so do texts with its special tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        if not isinstance(pre, ByteLevel) or pre.add_prefix_space or not pre.use_regex or self.tokenizer.normalizer is not None:
            raise ValueError("not a plain byte-level tokenizer")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in [" ", *map(chr, range(65, 91)), *map(chr, range(97, 123)), *_LATIN]}
        self.slots = np.full(2 * WORDS, -1, np.int32)
        self.keys = np.zeros((LANES, 0), _U)
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.long: dict[bytes, int] = {}

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        out: list[list[int]] = [[]] * len(texts)
        plain = [i for i, x in enumerate(texts) if PLAIN(x)]
        shown = "\n".join([texts[i] for i in plain]).translate(self.shown).split("\n")
        tokenize = self.tokenizer.model.tokenize
        for i, x in zip(plain, shown):
            out[i] = [t.id for t in tokenize(x)]
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * MIXER
        for k in range(1, LANES):
            h = (h ^ (h >> _U(29)) ^ keys[k]) * MIXER
        return (h >> _U(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key among the remembered, or -1."""
        out, todo, slot = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1]), self._slot(keys)
        while len(todo):
            k = self.slots[slot]
            there = np.flatnonzero(k >= 0)
            todo, slot, k = todo[there], slot[there], k[there]
            same = self.keys[0][k] == keys[0][todo]
            for i in range(1, LANES):
                same &= self.keys[i][k] == keys[i][todo]
            out[todo[same]] = k[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _keep(self, keys: np.ndarray, first: int) -> None:
        number, slot = np.arange(first, first + keys.shape[1]), self._slot(keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.slots) - 1)

    def encode(self, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``b`` one after another, and how many each text has; text i is b[first[i] : first[i + 1]]."""
        n = first[-1]
        at = cuts(b)
        at[first[:-1][first[:-1] < n]] = True
        begin = np.flatnonzero(at)
        size = np.diff(np.append(begin, n))
        most = 8 * LANES - 1
        # every stretch's bytes as whole numbers; the last byte holds the length
        wide = np.concatenate([b, np.zeros(8 * LANES, np.uint8)])
        eight = np.ndarray(len(wide) - 7, "<u8", wide.data, strides=(1,))
        short = size <= most
        s, z = begin[short], size[short]
        keys = np.zeros((LANES, len(s)), _U)
        for k in range(LANES):
            own = np.flatnonzero(z > 8 * k) if k else slice(None)
            keys[k, own] = eight[s[own] + 8 * k] & MASKS[np.minimum(z[own] - 8 * k, 8)]
        keys[-1] |= z.astype(_U) << _U(56)
        known = self._find(keys)
        lost = np.flatnonzero(known < 0)
        order = lost[np.lexsort(keys[:, lost])]
        new = np.r_[True, (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)] if len(order) else np.zeros(0, bool)
        fresh = order[new]
        raw = b.tobytes()
        pieces = [raw[i : i + j] for i, j in zip(s[fresh].tolist(), z[fresh].tolist())]
        words = len(self.size)
        known[order] = words + np.cumsum(new) - 1
        number = np.empty(len(begin), np.int64)
        number[short] = known
        others = np.flatnonzero(~short)
        more: dict[bytes, int] = {}
        for i in others.tolist():
            p = raw[begin[i] : begin[i] + size[i]]
            number[i] = self.long[p] if p in self.long else more.setdefault(p, words + len(fresh) + len(more))
        got = self._ids(pieces + list(more))
        all_size = np.concatenate([self.size, np.fromiter(map(len, got), np.int64, len(got))])
        all_flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32)])
        ids = ragged(all_flat, (np.cumsum(all_size) - all_size)[number], all_size[number])
        if len(all_size) <= WORDS:
            # a long stretch holds a number too, and a key that no text can have
            self.keys = np.concatenate([self.keys, keys[:, fresh], np.full((LANES, len(more)), _U(0xFFFFFFFFFFFFFFFF))], 1)
            self.size, self.flat = all_size, all_flat
            self._keep(keys[:, fresh], words)
            self.long |= {p: k for p, k in more.items() if len(p) < 256}
        upto = np.r_[0, np.cumsum(all_size[number])]
        counts = np.diff(upto[np.searchsorted(begin, first)])
        return self._special(raw, first, ids, counts) if any(x in raw for x in self.special) else (ids, counts)

    def _special(self, raw: bytes, first: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string, through the whole tokenizer."""
        texts = [raw[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, t in enumerate(texts):
            if any(x in t for x in self.special):
                parts[i] = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, whose memory is bounded."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Of a worker that goes on to other work."""
    if _encoders:
        _encoders.clear()
        release_memory()


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + size], one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def re_pair(ids: np.ndarray, last: np.ndarray, vocabulary: int, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, which of them end a document, and rules (pairs of symbols), when no pair occurs ``least`` times any more.

    In each round all frequent pairs become nonterminals, replaced from left to right without overlap;
    pairs with the new nonterminals are what the next round looks at. A pair that wasn't frequent can't become so
    later, so only places beside a new nonterminal, and those where a frequent pair was in another's way, are counted again.
    """
    seq, last, rules, top = ids.astype(np.uint32), last.copy(), [np.zeros((0, 2), np.int64)], vocabulary
    look = np.flatnonzero(~last[:-1])
    while len(look):
        kind, bits = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
        key = seq[look].astype(kind) << kind(bits) | seq[look + 1].astype(kind)
        s = np.sort(key)
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        pairs = s[edge][np.diff(np.append(edge, len(s))) >= least]
        if not len(pairs):
            break
        # pairs that share a slot wait for the next round, all but one
        place = lambda x: (x.astype(_U) * MIXER >> _U(44)).astype(np.int32)
        slots, crowd, slot = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, bool), place(pairs)
        slots[slot] = np.arange(len(pairs))
        crowd[slot[slots[slot] != np.arange(len(pairs))]] = True
        slot = place(key)
        k = slots[slot]
        found = pairs[k] == key
        late = look[crowd[slot] & ~found]
        at, k = look[found], k[found]
        # of pairs that overlap in a run, every other one is taken
        start = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        wait, at, k = at[~take], at[take], k[take]
        used = np.flatnonzero(np.bincount(k, minlength=len(pairs)))
        number = np.zeros(len(pairs), np.int64)
        number[used] = top + np.arange(len(used))
        seq[at] = number[k]
        rules.append(np.stack([pairs[used] >> kind(bits), pairs[used] & kind((1 << bits) - 1)], 1).astype(np.int64))
        top += len(used)
        last[at] = last[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        again = np.zeros(len(seq) + 1, bool)
        again[at] = again[wait] = again[late] = True
        again[at[at > 0] - 1] = True
        # the place before a pair may itself be the pair before
        twice = at[(at > 1) & ~stays[at - 1]]
        again[twice - 2] = True
        again = again[:-1] & stays
        seq, last = seq[stays], last[stays]
        look = np.flatnonzero(again[stays][:-1] & ~last[:-1])
    return seq, last, np.concatenate(rules)


def lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids in the expansion of each rule."""
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((1 if a < vocabulary else size[a - vocabulary]) + (1 if b < vocabulary else size[b - vocabulary]))
    return np.array(size, np.int64)


def expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids of every symbol, with start and length of each."""
    size = np.ones(vocabulary + len(rules), np.int64)
    parts: list[np.ndarray] = [np.arange(vocabulary)]
    done: list[np.ndarray] = []
    one = lambda s: np.array([s]) if s < vocabulary else done[s - vocabulary]
    for a, b in rules.tolist():
        done.append(np.concatenate([one(a), one(b)]))
    size[vocabulary:] = [len(x) for x in done]
    flat = np.concatenate(parts + done)
    return flat, np.cumsum(size) - size, size


def pack(doc_ids: list[int], tokens: list[np.ndarray], vocabulary: int) -> bytes:
    counts = np.array([len(x) for x in tokens], np.int64)
    ids = np.concatenate(tokens)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    seq, last, rules = re_pair(ids, last, vocabulary)
    size = lengths(rules, vocabulary)
    ends = np.flatnonzero(last) + 1
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, len(doc_ids), len(rules), len(seq), vocabulary, width)
    parts = [np.array(doc_ids, "<i8"), np.diff(ends, prepend=0).astype("<u4"), counts.astype("<u4"), rules.astype("<u4"), size.astype("<u4"), seq.astype(f"<u{width}")]
    return head + b"".join(x.tobytes() for x in parts)


class TokenFile:
    def __init__(self, data: bytes) -> None:
        magic, docs, rules, symbols, self.vocabulary, width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, symbols_of, self.tokens = take("<i8", docs), take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules).astype(np.int64)
        self.seq = take(f"<u{width}", symbols).astype(np.int64)
        self.ends = np.cumsum(symbols_of)
        self.starts = self.ends - symbols_of

    def all(self) -> np.ndarray:
        flat, start, size = expansions(self.rules, self.vocabulary)
        return ragged(flat, start[self.seq], size[self.seq])

    def read_tokens(self, doc: int, begin: int, end: int) -> list[int]:
        """Tokens begin to end (exclusive) of the file's document number ``doc``; expands no more rules than it must."""
        seq = self.seq[self.starts[doc] : self.ends[doc]]
        size = np.where(seq < self.vocabulary, 1, self.sizes[np.maximum(seq - self.vocabulary, 0)] if len(self.sizes) else 1)
        upto = np.cumsum(size)
        lo, hi = np.searchsorted(upto, begin, "right"), np.searchsorted(upto, end, "left") + 1
        out, stack = [], list(seq[lo:hi][::-1])
        while stack:
            s = int(stack.pop())
            if s < self.vocabulary:
                out.append(s)
            else:
                stack += self.rules[s - self.vocabulary][::-1].tolist()
        skip = begin - (int(upto[lo - 1]) if lo else 0)
        return out[skip : skip + end - begin]


def write_files(docs: DataFrame, tokenizer: str, folder: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files into ``folder`` (a URI that all executors reach): doc_id ascending over the files by name.

    Returns the files written: file, n_docs, n_tokens. Only files listed there count: a task that is run again
    writes files of its own, and those of a lost attempt are never listed. Null text counts as empty; null
    doc_ids are not allowed in the format and are written as -1; repeated doc_ids stay, ordered by a hash of their text.
    Other columns are not read. An empty table gives no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held = encoder(tokenizer)
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        task = TaskContext.get()
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        done = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, n
            name = f"{task.partitionId():08d}-{done:06d}-{task.taskAttemptId()}.tmg"
            with store.open_output_stream(f"{where}/{name}") as f:
                f.write(pack(ids, tokens, held.vocabulary))
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_tokens": [n]})
            ids.clear()
            tokens.clear()
            done, n = done + 1, 0
            return row

        for batch in batches:
            for rows, b, first in text_chunks(batch, "text", CHUNK):
                flat, counts = held.encode(b, first)
                for doc, x in zip(batch.column("doc_id")[rows.start : rows.stop].to_pylist(), np.split(flat, np.cumsum(counts)[:-1])):
                    if ids and n + len(x) + 1 > file_tokens:
                        yield flush()
                    ids.append(doc)
                    tokens.append(np.append(x, END).astype(np.uint32))
                    n += len(x) + 1
        if ids:
            yield flush()
        release_memory()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    # sorting and cutting into ranges also bounds what a task encodes; ranges follow the sizes seen at run time
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return rows.mapInArrow(write, "file string, n_docs long, n_tokens long")


def read_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Decodes the files: file, row (of the document in its file), doc_id, begin (first id in the file), n_tokens, ids_crc32 and, with ``ids``, the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                f = TokenFile(data.as_buffer())
                flat = f.all().astype("<u4")
                ends = np.cumsum(f.tokens)
                raw = memoryview(flat).cast("B")
                out = {"file": [path.rsplit("/", 1)[-1]] * len(ends), "row": np.arange(len(ends)), "doc_id": f.doc_ids, "begin": ends - f.tokens, "n_tokens": f.tokens}
                out["ids_crc32"] = np.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), f.tokens.tolist())], np.int64)
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "file string, row long, doc_id long, begin long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, name: str = "tokens", ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns the table of files, each with its first id's place in the whole, and what they hold."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, name)
    files = write_table(write_files(docs, tokenizer, folder), f"{name}-list")
    # one row for each file of millions of ids
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    if files.isEmpty():
        return files, spark.createDataFrame([], "file string, row long, doc_id long, begin long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    return files, read_files(spark, folder, ids)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that it writes."""
    files, held = token_files(docs, tokenizer, ids=False)
    rows = held.join(files.select("file", "first"), "file")
    return rows.select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its token files."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
