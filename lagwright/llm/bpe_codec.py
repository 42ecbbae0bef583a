"""Byte-level BPE as a bounded-lookahead streaming transducer, and back to text by an incremental state machine.

What stands right of a text can change its tokens only so far to the left. Let two texts agree up to the end of the
shorter one, and apply the merges in order. The border up to which their tokens agree moves left only where a merge
(u, v) joins the last agreed token u to what follows in one of the texts; from then on a token that begins with u stands
right of the border in both, so the next move needs a later merge whose right part begins with u. The longest such chain
of left parts is the sufficient lookahead, found in one pass over the merge list. Tokens that end that many bytes before
the end of what was read are stable.

The transducer reads bytes, keeps the last token of each prefix within the lookahead, emits what is stable and forgets
what lies before it: constant memory for words of any length. Words no longer than ``SHORT`` lie within the lookahead as
a whole; all distinct ones of a batch step through compiled states together and are read back from their ends.

Decoding looks up the bytes of tokens and turns them into text by a state machine that holds back at most three bytes of
an unfinished character; what is no UTF-8 becomes U+FFFD, once for each longest beginning of a character.

Null and empty texts have no ids and decode to the empty text; a null id list is empty, too. Ids that the vocabulary
lacks are skipped. Repeated rows are coded each for itself; other columns are not looked at.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_chunks, ragged, read, row_sums, text_buffer
from .token_counts import SPECIAL, Counter, WordCounter

#: Bytes of words that step through compiled states; longer ones are streamed.
SHORT = 64


def sufficient_lookahead(model: WordCounter) -> int:
    """How many bytes right of a token's end fix it, whatever follows them."""
    reach: dict[bytes, int] = {}  # of left parts: the longest chain that ends with a merge of it
    most = 0
    for a, b in model.parts[256:]:
        left, right = model.tokens[a], model.tokens[b]
        chain = len(left) + max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(chain, reach.get(left, 0))
        most = max(most, chain)
    return most


class Transducer:
    """Reads one word's bytes in any portions; feed() and finish() return the tokens that have become stable.

    ``held`` are the bytes after the last emitted token; last[k], start[k]: the last token of their first k bytes, and
    where it begins. Both are cut whenever they have grown to twice the lookahead.
    """

    def __init__(self, model: WordCounter, lookahead: int):
        self.model, self.lookahead = model, lookahead
        self.held, self.last, self.start = bytearray(), [-1], [0]

    def feed(self, portion: bytes) -> list[int]:
        out: list[int] = []
        for byte in portion:
            self.held.append(byte)
            self.step()
            if len(self.held) > 2 * self.lookahead:
                out += self.emit(len(self.held) - self.lookahead)
        return out

    def finish(self) -> list[int]:
        return self.emit(len(self.held))

    def step(self) -> None:
        """The last token of the held bytes: the longest that may follow what stands before it. None begins before the
        last emitted token's end, which is stable."""
        model, end = self.model, len(self.held)
        node, start, found = 0, end, []
        while start and (node := model.tree.get(node << 8 | self.held[start - 1])):
            start -= 1
            if model.token_at[node] >= 0:
                found.append((model.token_at[node], start))
        for token, start in reversed(found):
            before = self.last[start]
            if before < 0 or model.follows(before, token):
                self.last.append(token)
                self.start.append(start)
                return
        raise AssertionError("a single byte may follow anything that ends before it")

    def emit(self, until: int) -> list[int]:
        """The tokens that end at ``until`` or before, read back from the end of what is held."""
        out, end, cut = [], len(self.held), 0
        while end:
            if end <= until:
                cut = cut or end
                out.append(self.last[end])
            end = self.start[end]
        del self.held[:cut]
        self.last, self.start = self.last[cut:], [0, *(s - cut for s in self.start[cut + 1 :])]
        return out[::-1]


class Encoder:
    def __init__(self, path: str):
        self.counter = Counter(path)
        self.model = self.counter.words
        self.lookahead = sufficient_lookahead(self.model)
        self.size = np.array([len(t) for t in self.model.tokens])
        file = json.load(open(path, encoding="utf-8"))
        raw = raw_bytes(file)
        known = {raw[i]: i for i in raw if raw[i] != SPECIAL}
        self.id = np.array([known[t] for t in self.model.tokens], np.uint32)
        self.special = next((t["id"] for t in file["added_tokens"] if t["content"].encode() == SPECIAL), 0)

    def words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and each word's number of them."""
        model = self.model
        if len(model.last) > model.most:
            model.clear()
        starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        size = np.diff(starts)
        special = pc.equal(words, SPECIAL).to_numpy(zero_copy_only=False)
        counts = special.astype(np.int64)
        streamed = {}
        for i in np.flatnonzero(~special & (size > SHORT)):
            machine = Transducer(model, self.lookahead)
            streamed[i] = machine.feed(words[i].as_py()) + machine.finish()
            counts[i] = len(streamed[i])
        order = np.flatnonzero(~special & (size <= SHORT))
        order = order[np.argsort(-size[order], kind="stable")]  # longest first: those with a k-th byte stand in front
        ends = np.searchsorted(-size[order], -np.arange(int(size[order].max(initial=0)) + 1), "right")
        path = [np.zeros(len(order), np.int64)]
        for k in range(1, len(ends)):
            n = ends[k]
            at = model.transitions(path[-1][:n] << 8 | data[starts[order[:n]] + k - 1], words, order, path)
            counts[order[:n]] += model.emits[at]
            path.append(model.to[at])
        places = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(places[-1], np.uint32)
        out[places[:-1][special]] = self.special
        for i, tokens in streamed.items():
            out[places[i] : places[i + 1]] = self.id[tokens]
        # Back from the words' ends: the last token of each state, then the state at that token's beginning.
        states, base, last = np.concatenate(path), np.cumsum([0, *map(len, path)]), np.array(model.last)
        who, end, slot = np.arange(len(order)), size[order].copy(), places[order + 1] - 1
        while len(who):
            token = last[states[base[end] + who]]
            out[slot] = self.id[token]
            end = end - self.size[token]
            more = np.flatnonzero(end > 0)
            who, end, slot = who[more], end[more], slot[more] - 1
        return out, counts

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, and the rows' offsets in them."""
        words, bounds = self.counter.cut(data, offsets)
        coded = words.dictionary_encode()
        ids, counts = self.words(coded.dictionary)
        codes = coded.indices.to_numpy()
        places = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(row_sums(counts[codes], bounds))])
        return ids[ragged(places[codes], counts[codes])], ends


def raw_bytes(file: dict) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary file; a special token's are its own text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    found = {i: bytes(byte[c] for c in token) for token, i in file["model"]["vocab"].items() if all(c in byte for c in token)}
    return found | {t["id"]: t["content"].encode() for t in file["added_tokens"]}


# UTF-8 (fixed values): how many bytes a leading byte asks for, 0 if it leads nothing; what its second byte may be.
WANT, LOW, HIGH = np.zeros(256, np.int8), np.full(256, 0x80, np.uint8), np.full(256, 0xBF, np.uint8)
WANT[:0x80], WANT[0xC2:0xE0], WANT[0xE0:0xF0], WANT[0xF0:0xF5] = 1, 2, 3, 4
LOW[0xE0], HIGH[0xED], LOW[0xF0], HIGH[0xF4] = 0xA0, 0x9F, 0x90, 0x8F
REPLACEMENT = np.frombuffer("�".encode(), np.uint8)


def to_text(data: np.ndarray, offsets: np.ndarray, open_end: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Bytes of rows as UTF-8: the text's bytes, its offsets, and how many bytes at the very end wait for more of their
    character; those are left out, and only with ``open_end``. A character never goes over a row's end."""
    want = WANT[data]
    lead = np.flatnonzero(want > 1)
    ends = offsets[np.searchsorted(offsets, lead, "right")] if len(lead) else lead
    asked, last = want[lead], max(0, len(data) - 1)
    at = lambda k: data[np.minimum(lead + k, last)]
    good = (lead + 1 < ends) & (at(1) >= LOW[data[lead]]) & (at(1) <= HIGH[data[lead]])
    got = 1 + good.astype(np.int64)
    for k in (2, 3):
        good = good & (asked > k) & (lead + k < ends) & (at(k) & 0xC0 == 0x80)
        got += good
    whole, waiting = got == asked, 0
    if open_end and len(lead) and not whole[-1] and lead[-1] + got[-1] == len(data):
        waiting = int(got[-1])
    covered = want == 1
    for k in range(4):
        covered[lead[got > k] + k] = True
    stray = np.flatnonzero(~covered)
    if whole.all() and not len(stray):
        return data, offsets, 0
    sizes = np.ones(len(data), np.int64)
    broken, length = lead[~whole], got[~whole]
    sizes[ragged(broken, length)] = 0
    sizes[broken] = sizes[stray] = 3
    if waiting:
        sizes[len(data) - waiting :] = 0
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(places[-1], np.uint8)
    single = sizes == 1
    out[places[:-1][single]] = data[single]
    out[places[:-1][sizes == 3][:, None] + np.arange(3)] = REPLACEMENT
    return out, places[offsets], waiting


class Decoder:
    """Ids to text, in any portions: feed() returns the bytes of whole characters, finish() what is left."""

    def __init__(self, path: str):
        raw = raw_bytes(json.load(open(path, encoding="utf-8")))
        tokens = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.size = np.array([*map(len, tokens), 0])  # the last for ids that are not there
        self.place = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.held = np.zeros(0, np.uint8)

    def bytes_of(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.minimum(ids.astype(np.int64), len(self.size) - 1)
        size = self.size[known]
        return self.data[ragged(self.place[known], size)], np.concatenate([[0], np.cumsum(size)])[offsets]

    def feed(self, ids: np.ndarray) -> bytes:
        data = np.concatenate([self.held, self.bytes_of(ids, np.zeros(1, np.int64))[0]])
        text, _, waiting = to_text(data, np.array([0, len(data)]), open_end=True)
        self.held = data[len(data) - waiting :]
        return text.tobytes()

    def finish(self) -> bytes:
        text, _, _ = to_text(self.held, np.array([0, len(self.held)]))
        self.held = self.held[:0]
        return text.tobytes()

    def rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all rows' texts and their offsets."""
        text, places, _ = to_text(*self.bytes_of(ids, offsets))
        return text, places


@lru_cache(maxsize=1)
def encoder_at(path: str) -> Encoder:
    """One for each Python worker, so that states compiled for one task are there for the next."""
    return Encoder(path)


@lru_cache(maxsize=1)
def decoder_at(path: str) -> Decoder:
    return Decoder(path)


def as_array(kind: pa.DataType, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids of each row; ids as binary of unsigned 32-bit integers, least byte first. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encoder_at(tokenizer_path).rows(*text_buffer(batch.column(1)))
        packed = as_array(pa.binary(), ids.astype("<u4").view(np.uint8), ends * 4)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), packed], names=["id", "n_tokens", "ids"])

    return map_chunks(rows, work, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids binary", limit=4 << 20).withColumnRenamed("id", key)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ``ids`` (binary as encode() gives it) as column ``text``, in place of one of that name."""
    kept = [c for c in df.columns if c != text]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column(batch.schema.get_field_index(ids))
        packed = pc.fill_null(packed, b"") if packed.null_count else packed
        offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64) if len(packed) else np.zeros(1, np.int64)
        data = np.frombuffer(packed.buffers()[2], np.uint8) if len(packed) and packed.buffers()[2] is not None else np.zeros(0, np.uint8)
        found = decoder_at(tokenizer_path).rows(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4"), (offsets - offsets[0]) // 4)
        return pa.RecordBatch.from_arrays([*batch.columns, as_array(pa.string(), *found)], names=[*batch.schema.names, text])

    rows = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{text}` string"
    return map_chunks(rows, work, schema, ids, 4 << 20)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
