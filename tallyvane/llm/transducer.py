"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run over the text of a block of documents.

The *splitter* reads classes of characters and marks where words of the tokenizer's split pattern begin. Its state after
a character depends on few things, so each chunk of text becomes a map from state before to state after; the maps of all
chunks compose by a parallel prefix scan, and a second sweep, with every chunk's true entry state known, emits the marks.

The *counter* reads bytes of one word. Its state holds, for every position where a token that is still incomplete could
have begun, the trie node reached, the last token before that position and the tokens there relative to now; a transition
carries how many tokens the encoding of the prefix gains or loses. States compile when text first reaches them. Two tokens
may stand side by side in an encoding exactly if the merges of their joined bytes give them back, which makes the last
token of every prefix unique; so the sum of a word's transitions is its number of tokens. Words are chunks whose entry
state is the root; many chunks step through the transition table at once.

Compiled states are bounded: beyond MOST_STATES all but those that words are in are forgotten, wherever in a word that is.

Defined cases: a null or empty text has no bytes and no tokens; equal texts give equal rows; very long texts, and words, step through byte by
byte in bounded memory besides the block of texts itself; rows that repeat stay rows of their own; only the named columns are read, so that others can't clash; empty tables give no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyvane.llm.bpe import blocks

#: States a worker compiles before it starts anew. Bounds memory, never results.
MOST_STATES = 100_000
#: Bytes of text that one sweep covers at least, if the partition has them.
BLOCK_BYTES = 3 << 20
#: Chunks that step side by side.
LANES = 4096

# Classes of characters that the splitter reads.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, E, L = range(11)


def character_classes() -> np.ndarray:
    """Class of every code point: QUOTE starts a contraction, ONE (s t m d) ends it, R V E L are in re, ve and ll."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, everything):
            skipped = 0x800 * (np.arange(*m.span()) >= 0xD800)
            classes[np.arange(*m.span()) + skipped] = kind
    classes[ord(" ")], classes[ord("'")] = SPACE, QUOTE
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", L)):
        classes[[ord(x) for x in letters]] = kind
    return classes


# States of the splitter: what the word that holds the last character is.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, AFTER_RUN_SPACE, AFTER_RUN_BLANK, QUOTED,
 QUOTED_R, QUOTED_V, QUOTED_L, ENDED) = range(13)
#: What a transition marks: a word begins at this character, at the one before it, or at both.
NOTHING, HERE, ONE_AGO, ONE_AGO_AND_HERE = range(4)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each state and class.

    A space goes with the letters, numbers or others after it; a run of white space without the last character of it is
    a word if anything else follows. A quote that begins a word and goes on as a contraction is one; letters after
    it begin another word. If the contraction isn't completed (`'r` with no `e`), the quote is a word of its own and the
    letters after it are one.
    """
    state = np.zeros((13, 11), np.uint8)
    mark = np.zeros((13, 11), np.uint8)
    letters = {LETTER, ONE, R, V, E, L}
    for s in range(13):
        for c in range(11):
            white = s in (AFTER_SPACE, AFTER_BLANK, AFTER_RUN_SPACE, AFTER_RUN_BLANK)
            if c in (SPACE, BLANK):
                to = (AFTER_RUN_SPACE if c == SPACE else AFTER_RUN_BLANK) if white else (AFTER_SPACE if c == SPACE else AFTER_BLANK)
                state[s, c], mark[s, c] = to, NOTHING if white else HERE
                continue
            kind = IN_LETTERS if c in letters else IN_NUMBERS if c == NUMBER else IN_OTHER
            if c == QUOTE and s in (START, IN_LETTERS, IN_NUMBERS, AFTER_BLANK, AFTER_RUN_BLANK, ENDED):
                state[s, c] = QUOTED
                mark[s, c] = ONE_AGO_AND_HERE if s == AFTER_RUN_BLANK else HERE
                continue
            if s in (QUOTED, QUOTED_R, QUOTED_V, QUOTED_L):
                ends = c == ONE if s == QUOTED else c == (L if s == QUOTED_L else E)
                half = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}.get(c) if s == QUOTED else None
                if ends:
                    state[s, c], mark[s, c] = ENDED, NOTHING
                elif half is not None:
                    state[s, c], mark[s, c] = half, NOTHING
                elif s == QUOTED:  # a plain quote: others go on with it, all else begins a word
                    state[s, c], mark[s, c] = (IN_OTHER, NOTHING) if kind == IN_OTHER else (kind, HERE)
                elif kind == IN_LETTERS:
                    state[s, c], mark[s, c] = IN_LETTERS, ONE_AGO
                else:
                    state[s, c] = QUOTED if c == QUOTE else kind
                    mark[s, c] = ONE_AGO_AND_HERE
                continue
            state[s, c] = kind
            if s == AFTER_SPACE:
                mark[s, c] = NOTHING
            elif s == AFTER_RUN_SPACE:
                mark[s, c] = ONE_AGO
            elif s == AFTER_RUN_BLANK:
                mark[s, c] = ONE_AGO_AND_HERE
            else:
                mark[s, c] = NOTHING if kind == s else HERE
    # `'r` at the end of a text or before white space: the letter is a word of its own.
    for s in (QUOTED_R, QUOTED_V, QUOTED_L):
        for c in (SPACE, BLANK):
            mark[s, c] = ONE_AGO_AND_HERE
    return state, mark


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row k becomes the map of chunks 0 to k one after the other."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def word_starts(classes: np.ndarray, fresh: np.ndarray, state: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character; fresh: whether a text begins there."""
    n = len(classes)
    out = np.zeros(n + 1, bool)
    if not n:
        return out[:n]
    width = max(64, -(-n // LANES))
    lanes = -(-n // width)
    # Class 11 + c stands for class c at the start of a text: from any state, as from START.
    table = np.concatenate([state, np.repeat(state[START : START + 1], 13, 0)], 1)
    marks = np.concatenate([mark, np.repeat(mark[START : START + 1], 13, 0)], 1)
    for s in (QUOTED_R, QUOTED_V, QUOTED_L):  # the half contraction that the text before ended in
        marks[s, 11:] = np.where(marks[START, 11:] == HERE, ONE_AGO_AND_HERE, marks[s, 11:])
    symbols = np.full(lanes * width, 11 + OTHER, np.uint8)
    symbols[:n] = classes + np.uint8(11) * fresh
    symbols = np.ascontiguousarray(symbols.reshape(lanes, width).T)
    flat, flat_marks = table.ravel(), marks.ravel()
    maps = np.broadcast_to(np.arange(13, dtype=np.uint16), (lanes, 13)).copy()
    for row in symbols:
        maps = flat[maps * np.uint16(22) + row[:, None]].astype(np.uint16)
    whole = compose(maps)
    at = np.concatenate([[START], whole[:-1, START]]).astype(np.uint16)
    told = np.empty((width, lanes), np.uint8)
    for k, row in enumerate(symbols):
        key = at * np.uint16(22) + row
        told[k] = flat_marks[key]
        at = flat[key].astype(np.uint16)
    told = told.T.ravel()[:n]
    out[:n] = (told == HERE) | (told == ONE_AGO_AND_HERE)
    ago = np.flatnonzero(told >= ONE_AGO)
    out[ago - 1] = True
    # A half contraction at the very end: its letter is a word of its own.
    lane = (n - 1) // width
    end = int(whole[lane - 1, START]) if lane else START
    for k in range(lane * width, n):
        end = int(flat[end * 22 + int(classes[k]) + 11 * int(fresh[k])])
    if end in (QUOTED_R, QUOTED_V, QUOTED_L):
        out[n - 1] = True
    return out[:n]


class Counter:
    """The lazily compiled transducer from bytes of a word to changes of the number of tokens."""

    def __init__(self, vocab: dict[bytes, int], parts: dict[int, tuple[int, int]]):
        self.parts = parts  # of each merged token, the two it is made of; a token's id is its rank
        self.merged = {pair: token for token, pair in parts.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, token in vocab.items():
            node = 0
            for b in word:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][b]
            self.token[node] = token
        self.reset()

    def reset(self) -> None:
        self.side: dict[tuple[int, int], bool] = {}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.next = np.full((1024, 256), -1, np.int32)
        self.gain = np.zeros((1024, 256), np.int8)

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges of left's bytes and right's bytes give these two tokens: undo the latest merges at the
        seam, one by one, and see that none of the pairs met there would have merged before."""
        if left < 0:
            return True
        if (left, right) in self.side:
            return self.side[left, right]
        a, b, until = left, right, 1 << 60
        good = True
        while True:
            token = self.merged.get((a, b))
            if token is not None and token < until:
                good = False
                break
            # Of two tokens at the seam the later made one is taken apart; equal ones: the left was made first.
            if a > b:
                if a not in self.parts:
                    if b not in self.parts:
                        break
                    until, b = b + 1, self.parts[b][0]
                else:
                    until, a = a, self.parts[a][1]
            elif b in self.parts:
                until, b = b + 1, self.parts[b][0]
            elif a in self.parts:
                until, a = a, self.parts[a][1]
            else:
                break
        self.side[left, right] = good
        return good

    def compile(self, state: int, byte: int) -> None:
        open_, found = [], None
        for node, last, tokens in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token >= 0 and self.adjacent(last, token):
                found = (token, tokens + 1)
            if self.children[child]:
                open_.append((child, last, tokens))
        token, gain = found
        new = (*((node, last, tokens - gain) for node, last, tokens in open_), (0, token, 0))
        self.next[state, byte], self.gain[state, byte] = self.add(new), gain

    def add(self, new: tuple) -> int:
        """Number of a state, a new one if need be."""
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            if len(self.states) > len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return self.number[new]

    def restart(self, state: np.ndarray) -> np.ndarray:
        """Forget all states but the given ones; these, numbered anew."""
        kept, where = np.unique(state, return_inverse=True)
        held = [self.states[k] for k in kept.tolist()]
        self.reset()
        return np.array([self.add(x) for x in held], np.int64)[where]

    def gains(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Change of the number of tokens at each byte; start: whether a word begins there."""
        n = len(data)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        # Chunks of about equal length that begin where words begin.
        begins = np.flatnonzero(start)
        cuts = np.unique(begins[np.minimum(np.searchsorted(begins, np.arange(0, n, max(64, n // LANES))), len(begins) - 1)])
        lengths = np.diff(np.append(cuts, n))
        order = np.argsort(-lengths, kind="stable")
        at, lengths = cuts[order], lengths[order]
        state = np.zeros(len(at), np.int64)
        left = len(at)
        for step in range(int(lengths[0])):
            while left and lengths[left - 1] <= step:
                left -= 1
            here = at[:left] + step
            byte = data[here]
            now = np.where(start[here], 0, state[:left])
            key = now * 256 + byte
            to = self.next.ravel()[key]
            while (unknown := np.flatnonzero(to < 0)).size:
                for k in np.unique(key[unknown]).tolist():
                    self.compile(k >> 8, k & 255)
                to = self.next.ravel()[key]
            out[here] = self.gain.ravel()[key]
            state[:left] = to
            # Words without end, as of scripts without spaces, make new states at every byte.
            if len(self.states) > MOST_STATES:
                state[:left] = self.restart(state[:left])
        return out


def readable_bytes() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary file stands: printable bytes for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library, compiled to transducers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, byte = file["model"], readable_bytes()
        self.special = [x["content"] for x in file["added_tokens"]]
        raw = {t: bytes(byte[c] for c in t) for t in model["vocab"] if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ids by order of merging, whatever the file's ids are: a token's id is the rank of its merge.
        made = {a + b for a, b in merges}
        order = {t: k for k, t in enumerate([t for t in raw if t not in made] + [a + b for a, b in merges])}
        self.counter = Counter({raw[t]: k for t, k in order.items()}, {order[a + b]: (order[a], order[b]) for a, b in merges})
        self.classes = character_classes()
        self.state, self.mark = splitter()

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        tokens = np.zeros(len(texts), np.int64)
        size = np.zeros(len(texts), np.int64)
        spans, owner = [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            size[k] = len(t.encode())
            parts = [t]
            for mark in self.special:  # the library takes these strings out first, as one token each
                if mark in t:
                    tokens[k] += sum(p.count(mark) for p in parts)
                    parts = [x for p in parts for x in p.split(mark)]
            for p in parts:
                if p:
                    spans.append(p)
                    owner.append(k)
        if not spans:
            return size, tokens
        whole = "".join(spans)
        lengths = np.fromiter(map(len, spans), np.int64, len(spans))
        firsts = np.cumsum(lengths) - lengths
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        fresh = np.zeros(len(points), bool)
        fresh[firsts] = True
        starts = word_starts(self.classes[points], fresh, self.state, self.mark)
        data = np.frombuffer(whole.encode(), np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.zeros(len(data), bool)
        at[lead[starts]] = True
        gains = self.counter.gains(data, at)
        np.add.at(tokens, owner, np.add.reduceat(gains.astype(np.int64), lead[firsts]))
        return size, tokens


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The compiled tokenizer of this Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def token_counts(docs: DataFrame, path: str, *, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed `limit`: no shuffle, each partition by itself.

    Returns key, n_bytes, n_tokens and over_limit. Other columns of `docs` are left out, whatever their names.
    """
    kind = docs.schema[key].dataType
    fields = [("key", kind), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        compiled = tokenizer(path)
        for table in blocks(batches, "text", BLOCK_BYTES):
            size, tokens = compiled.count(table.column("text").to_pylist())
            done = pa.Table.from_arrays([table.column("key"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=schema.names)
            yield from done.combine_chunks().to_batches(max_chunksize=10_000)

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
