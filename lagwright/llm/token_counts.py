"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for a byte-level BPE tokenizer, both compiled to arrays, both with counts of what a
transition emits on their transitions.

The outer one cuts a text into words as the tokenizer's pattern does. Its alphabet are a few character classes, into
which the pattern's bounded look-ahead is worked; its transitions emit a word or none. Texts of a batch form one string of
classes, cut into chunks of equal length. Each chunk becomes a map from an entry state to its exit state and to what it
emits on the way; the maps compose in a parallel prefix scan, which gives each chunk's entry state and the number of the
first word that begins in it.

The inner one reads a word's bytes. Its states are byte strings that begin some word, its transitions carry the change in
the number of emitted tokens. By the prefix property of BPE the encoding of s + b ends in a token t such that the rest of
it is the encoding of what stands before t; which t, is decided by whether t may follow the last token before it. So a new
transition needs a few look-ups among its ancestors; transitions are compiled as words come and dropped beyond a bound.
All distinct words of a batch step through the machine at once, a byte at a time, and add up what is emitted.

Null and empty texts count 0 tokens. Repeated rows are counted each for itself; other columns are not looked at. Words
of any length work: beyond ``LONG`` bytes their states are not kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_chunks, read, row_sums, text_buffer

# Character classes. Blank and other white space, where a run goes on or the text ends: REST. The last of a run before
# something else: BLANK or BREAK. An apostrophe before s, t, m, d: SHORT; before re, ve, ll: LONGER.
LETTER, DIGIT, SIGN, SHORT, LONGER, BLANK, BREAK, REST = range(8)
# States: a word has ended; inside letters, digits, signs; in white space; after a blank that joins what follows; in a
# contraction with one or two letters to come.
ENDED, LETTERS, DIGITS, SIGNS, WHITE, JOIN, ONE, TWO = range(8)
STATES, CLASSES = 8, 16  # each class also occurs as the first of a text, which is as after ENDED

LONG = 256
CHUNK = 64
SPECIAL = b"<|endoftext|>"


def outer_machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and begins[state, class]."""
    to = np.zeros((STATES, CLASSES), np.uint8)
    begins = np.ones((STATES, CLASSES), bool)
    fresh = {LETTER: LETTERS, DIGIT: DIGITS, SIGN: SIGNS, SHORT: ONE, LONGER: TWO, BLANK: JOIN, BREAK: ENDED, REST: WHITE}
    for c, s in fresh.items():
        to[:, c] = s
    for inside, c in ((LETTERS, LETTER), (DIGITS, DIGIT), (SIGNS, SIGN), (SIGNS, SHORT), (SIGNS, LONGER), (WHITE, REST)):
        to[inside, c], begins[inside, c] = inside, False
    for c, s in ((LETTER, LETTERS), (DIGIT, DIGITS), (SIGN, SIGNS), (SHORT, SIGNS), (LONGER, SIGNS)):
        to[JOIN, c], begins[JOIN, c] = s, False
    to[TWO], begins[TWO] = ONE, False
    to[ONE], begins[ONE] = ENDED, False
    to[:, 8:], begins[:, 8:] = to[ENDED, :8], True
    return to, begins


def scan(classes: np.ndarray, to: np.ndarray, begins: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The places of ``classes`` at which a word begins, from state ENDED."""
    n = len(classes)
    rows = max(1, -(-n // chunk))
    padded = np.zeros(rows * chunk, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    flat, emits = to.ravel(), begins.ravel()
    # maps[i, s] and words[i, s]: the state after chunk i entered in s, and the words begun on the way.
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    words = np.zeros((rows, STATES), np.int32)
    for c in steps:
        at = (maps << 4) + c[:, None]
        words += emits[at]
        maps = flat[at]
    # Parallel prefix scan: after the step of width w, row i is the composition of the 2w chunks up to i.
    width = 1
    while width < rows:
        before = maps[:-width].copy()
        words[width:] = words[:-width] + np.take_along_axis(words[width:], before, 1)
        maps[width:] = np.take_along_axis(maps[width:], before, 1)
        width *= 2
    state, number = np.full(rows, ENDED, np.uint8), np.zeros(rows, np.int64)
    state[1:], number[1:] = maps[:-1, ENDED], words[:-1, ENDED]
    out = np.empty(int(words[-1, ENDED]), np.int64)
    place = np.arange(rows) * chunk
    for k, c in enumerate(steps):
        at = (state << 4) + c
        hit = np.flatnonzero(emits[at])
        out[number[hit]] = place[hit] + k
        number[hit] += 1
        state = flat[at]
    return out[: np.searchsorted(out, n)]


def class_table() -> np.ndarray:
    """LETTER, DIGIT, SIGN or REST (white space) of each code point."""
    table = np.full(0x110000, SIGN, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            table[i] = LETTER if kind == "L" else DIGIT
    # White_Space of Unicode (fixed values).
    for i in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[i] = REST
    return table


def classify(points: np.ndarray, firsts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of code points; firsts and ends mark the first and the last of each text."""
    kinds = table[points]
    after = np.append(kinds[1:], REST)
    white = kinds == REST
    last = white & (after != REST) & ~ends
    kinds[last] = np.where(points[last] == 32, BLANK, BREAK)
    marks = np.flatnonzero((points == 39) & ~ends)
    if len(marks):
        one = points[marks + 1]
        kinds[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        two = marks[~ends[marks + 1]]
        pair = points[two + 1].astype(np.int64) << 21 | points[two + 2]
        kinds[two[np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONGER
    return kinds + firsts.astype(np.uint8) * 8


class WordCounter:
    """The inner transducer over a vocabulary file of byte-level BPE; ``most``: the states kept from batch to batch."""

    def __init__(self, path: str, most: int = 1_000_000):
        model = json.load(open(path, encoding="utf-8"))["model"]
        # The printable stand-ins of bytes in such files: printable Latin-1 for itself, the rest from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(byte[c] for c in s)
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # Tokens in the order of their merges, each with the pair that makes it; single bytes come first, made of nothing.
        self.tokens, number = [bytes([b]) for b in range(256)], {bytes([b]): b for b in range(256)}
        self.parts = [(b, b) for b in range(256)]
        self.merged: dict[int, int] = {}
        for a, b in merges:
            pair, whole = (number[raw(a)], number[raw(b)]), raw(a) + raw(b)
            if whole not in number:
                number[whole] = len(self.tokens)
                self.tokens.append(whole)
                self.parts.append(pair)
            self.merged[pair[0] << 20 | pair[1]] = number[whole]
        # The tokens read backwards, as a tree: node << 8 | byte to node, and the token that ends (begins) at a node.
        self.tree: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for number, token in enumerate(self.tokens):
            node = 0
            for b in reversed(token):
                step = self.tree.setdefault(node << 8 | b, len(self.token_at))
                if step == len(self.token_at):
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = number
        self.most = most
        self.joins: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        # State 0 is the empty string, with no token. Transitions: sorted keys state << 8 | byte, each with the state that
        # it leads to and the change in the number of tokens. last: the last token of each state, count: its tokens.
        self.keys, self.to, self.emits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last, self.count = [-1], [0]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a: no merge over the border comes before a merge inside them."""
        known = self.joins.get(a << 20 | b)
        if known is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[a << 20 | b] = self.stays(a, b)
        return known

    def stays(self, x: int, y: int) -> bool:
        """The tokens' merges are undone from the last one back; at each stage the two at the border may have a merge only
        if it comes later than the one that was undone last."""
        undone = len(self.tokens)
        while True:
            if self.merged.get(x << 20 | y, undone) < undone:
                return False
            # Of two equal tokens the left one was merged first, so the right one is undone first.
            if x > y and x > 255:
                undone, x = x, self.parts[x][1]
            elif y > 255:
                undone, y = y + 1, self.parts[y][0]
            elif x > 255:
                undone, x = x, self.parts[x][1]
            else:
                return True

    def last_token(self, word: bytes, end: int, last: Callable[[int], int]) -> tuple[int, int]:
        """The last token of word[:end] and where it begins. last: the last token of the word up to a place before."""
        found, node, start = [], 0, end
        while start and (node := self.tree.get(node << 8 | word[start - 1])):
            start -= 1
            if self.token_at[node] >= 0:
                found.append((self.token_at[node], start))
        for token, start in reversed(found):
            if start == 0 or self.follows(last(start), token):
                return token, start
        raise AssertionError("a single byte may follow anything that ends before it")

    def __call__(self, words: pa.BinaryArray) -> np.ndarray:
        """The number of tokens of each word."""
        if len(self.last) > self.most:
            self.clear()
        starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        size = np.diff(starts)
        counts = np.zeros(len(words), np.int64)
        special = pc.equal(words, SPECIAL).to_numpy(zero_copy_only=False)
        counts[special] = 1
        for i in np.flatnonzero(~special & (size > LONG)):
            counts[i] = self.long(words[i].as_py())
        order = np.flatnonzero(~special & (size <= LONG))
        order = order[np.argsort(-size[order], kind="stable")]  # longest first: those with a k-th byte stand in front
        ends = np.searchsorted(-size[order], -np.arange(int(size[order].max(initial=0)) + 1), "right")
        path = [np.zeros(len(order), np.int64)]
        for k in range(1, len(ends)):
            n = ends[k]
            symbols = path[-1][:n] << 8 | data[starts[order[:n]] + k - 1]
            at = self.transitions(symbols, words, order, path)
            counts[order[:n]] += self.emits[at]
            path.append(self.to[at])
        return counts

    def transitions(self, symbols: np.ndarray, words: pa.BinaryArray, order: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
        """The number of each symbol's transition; those that are not there yet are compiled. path: the states of all
        words after each byte before."""
        at = np.searchsorted(self.keys, symbols)
        known = np.zeros(len(symbols), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == symbols[inside]
        if known.all():
            return at
        new, who = np.unique(symbols[~known], return_index=True)
        who = np.flatnonzero(~known)[who]
        end, first = len(path), len(self.last)
        emits = np.empty(len(new), np.int64)
        for i, (w, word) in enumerate(zip(who.tolist(), words.take(pa.array(order[who])).to_pylist(), strict=True)):
            token, start = self.last_token(word, end, lambda k: self.last[path[k][w]])
            self.last.append(token)
            self.count.append(self.count[path[start][w]] + 1)
            emits[i] = self.count[-1] - self.count[path[-1][w]]
        place = np.searchsorted(self.keys, new)
        self.keys = np.insert(self.keys, place, new)
        self.to = np.insert(self.to, place, first + np.arange(len(new)))
        self.emits = np.insert(self.emits, place, emits)
        return np.searchsorted(self.keys, symbols)

    def long(self, word: bytes) -> int:
        """The same without kept states: as many steps as bytes, memory for the last tokens."""
        count, last = [0], [-1]
        for end in range(1, len(word) + 1):
            token, start = self.last_token(word, end, last.__getitem__)
            count.append(count[start] + 1)
            last.append(token)
        return count[-1]


class Counter:
    def __init__(self, path: str):
        self.words, self.table, self.machine = WordCounter(path), class_table(), outer_machine()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words of all rows as the pattern cuts them, and the bounds of each row's words among them."""
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point among the bytes
        cuts = [offsets[:-1], offsets[1:]]
        special, at = [], raw.find(SPECIAL)
        while at >= 0:
            # Inside one row only; the string is one word, and texts end and begin at its sides.
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(SPECIAL) - 1, "right"):
                special.append(at)
                at = raw.find(SPECIAL, at + len(SPECIAL))
            else:
                at = raw.find(SPECIAL, at + 1)
        if special:
            held = np.array(special)
            cuts += [held, held + len(SPECIAL)]
        heads = np.unique(np.concatenate(cuts))
        firsts = np.zeros(len(points) + 1, bool)
        firsts[np.searchsorted(place, heads)] = True
        ends = firsts[1:].copy()
        ends[-1] = True
        begins = scan(classify(points, firsts[:-1], ends, self.table), *self.machine)
        if special:  # no word begins inside a special string
            inside = np.searchsorted(place, held)
            last = inside[np.maximum(np.searchsorted(inside, begins, "right") - 1, 0)]
            begins = begins[~((begins > last) & (begins < last + len(SPECIAL)))]
        starts = place[begins]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(raw)])
        return words, np.searchsorted(starts, offsets)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        words, bounds = self.cut(data, offsets)
        coded = words.dictionary_encode()
        return row_sums(self.words(coded.dictionary)[coded.indices.to_numpy()], bounds)


@lru_cache(maxsize=1)
def counter_at(path: str) -> Counter:
    """One for each Python worker, so that states compiled for one task are there for the next."""
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(1))
        n = counter_at(tokenizer_path).rows(data, offsets)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(rows.dtypes)["id"]
    return map_chunks(rows, work, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", limit=8 << 20).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
