"""Counting tokens of a byte-level BPE with finite-state transducers.

Two deterministic transducers are compiled from the tokenizer's file:

* The *splitter* reads characters and marks where pieces begin (runs of letters, numbers, other signs
  and white space, and contractions). A transition says whether the character it reads, or the one
  before, begins a piece, as white space is only understood one character later. Its state after a
  chunk of text is a function of the state before it; these maps of all chunks are composed by a
  parallel prefix scan, so every chunk then runs on its own from its true state.
* The *merger* reads the bytes of a piece; a transition carries the change of the number of tokens.
  After each prefix of a piece only the last token of its encoding matters for what may follow, and
  that only at places to which a longer token can still reach back. A state is therefore the bytes
  which may still grow into a token, with the last token and the relative count at each of their
  ends. States and transitions are built when they are first met, and kept. A long piece is cut into
  chunks, which run side by side: a chunk maps the states it may be entered in, those in which the
  chunk before may end, to a state and a number of tokens, and these maps are composed by a parallel
  prefix scan. What is entered in a state not foreseen runs again from that.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import pre_tokenizers

from boxoffice.llm.textkit import Memo, fingerprints, first_of_each, per_text, text_bytes

# Symbols of the splitter: ends of texts, the letters of contractions, and kinds of characters.
END, STMD, RV, LL, EE, LETTER, NUMBER, QUOTE, OTHER, BLANK, WHITE = range(11)
_LETTERS = (STMD, RV, LL, EE, LETTER)
# Its states: a piece begins next; within letters, numbers, signs; after a quote that begins a piece,
# then after its r or v, or its l; one white character, or more, the last of them a blank or not.
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, QUOTED, QUOTED_RV, QUOTED_L, BLANK1, WHITE1, BLANK2, WHITE2 = range(11)
HERE, BEFORE = 1, 2
CHUNK = 256
#: Bytes of a chunk of a long piece, and rounds in which all its chunks look for the states they may be
#: entered in; after these only true states are followed.
STRETCH, GUESSES = 512, 4


def _begin(symbol: int) -> tuple[int, int]:
    if symbol == END:
        return FRESH, 0
    if symbol in _LETTERS:
        return IN_LETTERS, HERE
    return {NUMBER: IN_NUMBERS, QUOTE: QUOTED, OTHER: IN_SIGNS, BLANK: BLANK1, WHITE: WHITE1}[symbol], HERE


def _joined(symbol: int) -> tuple[int, int]:
    """After a blank that the piece takes in."""
    return IN_LETTERS if symbol in _LETTERS else IN_NUMBERS if symbol == NUMBER else IN_SIGNS, 0


def _move(state: int, symbol: int) -> tuple[int, int]:
    if state in (QUOTED_RV, QUOTED_L):
        if symbol == (EE if state == QUOTED_RV else LL):
            return FRESH, 0
        to, mark = _move(IN_LETTERS, symbol)
        return to, mark | BEFORE
    if symbol == END or state == FRESH:
        return _begin(symbol)
    if state == QUOTED:
        if symbol in (STMD, RV, LL):
            return {STMD: FRESH, RV: QUOTED_RV, LL: QUOTED_L}[symbol], 0
        return (IN_SIGNS, 0) if symbol in (QUOTE, OTHER) else _begin(symbol)
    if state in (BLANK1, WHITE1, BLANK2, WHITE2):
        if symbol in (BLANK, WHITE):
            return BLANK2 if symbol == BLANK else WHITE2, 0
        to, mark = _joined(symbol) if state in (BLANK1, BLANK2) else _begin(symbol)
        return to, mark | (BEFORE if state in (BLANK2, WHITE2) else 0)
    same = {IN_LETTERS: _LETTERS, IN_NUMBERS: (NUMBER,), IN_SIGNS: (QUOTE, OTHER)}[state]
    return (state, 0) if symbol in same else _begin(symbol)


_STATES = _SYMBOLS = 11
_PAIRS = [_move(s, x) for s in range(_STATES) for x in range(_SYMBOLS)]
NEXT = np.array([p[0] for p in _PAIRS], np.uint8)
MARK = np.array([p[1] for p in _PAIRS], np.uint8)


def compose(maps: np.ndarray) -> np.ndarray:
    """Maps of the states before each chunk from the state at the front: an exclusive prefix scan of
    function composition in log2(chunks) steps. ``maps``: chunks x states."""
    out = np.empty_like(maps)
    out[0], out[1:] = np.arange(maps.shape[1]), maps[:-1]
    step = 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


def run_splitter(symbols: np.ndarray) -> np.ndarray:
    """The marks of all transitions, from a fresh state. Every chunk runs once from the fresh state;
    from all states only until they have met, and again from its true state only that far."""
    n = len(symbols)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    marks = np.empty_like(columns)
    state = np.full(chunks, FRESH, np.uint8)
    for k, column in enumerate(columns):
        at = state * np.uint8(_SYMBOLS) + column
        marks[k], state = MARK[at], NEXT[at]
    # A chunk whose states have met maps them all to where the fresh state led.
    maps = np.repeat(state[:, None], _STATES, axis=1)
    apart, met = np.arange(chunks), np.full(chunks, CHUNK)
    lanes = np.tile(np.arange(_STATES, dtype=np.uint8), (chunks, 1))
    for k, column in enumerate(columns):
        lanes = NEXT[lanes * np.uint8(_SYMBOLS) + column[apart, None]]
        if k % 4 == 3:
            same = (lanes == lanes[:, :1]).all(axis=1)
            met[apart[same]] = k + 1
            apart, lanes = apart[~same], lanes[~same]
            if not len(apart):
                break
    maps[apart] = lanes
    entry = compose(maps)[:, FRESH]
    again = np.flatnonzero(entry != FRESH)
    state, until, k = entry[again], met[again], 0
    while len(again):
        at = state * np.uint8(_SYMBOLS) + columns[k, again]
        marks[k, again], state = MARK[at], NEXT[at]
        k += 1
        on = until > k
        again, state, until = again[on], state[on], until[on]
    return marks.T.reshape(-1)[:n]


class Splitter:
    """Pieces of texts. The kind of a character is asked of the library once per code point."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        rule = spec["pre_tokenizer"]
        if rule["type"] != "ByteLevel" or rule["add_prefix_space"] or not rule["use_regex"] or spec["normalizer"]:
            raise ValueError("only plain byte-level tokenizers can be compiled")
        self._rule = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        self._ascii = np.array([self._kind(chr(c)) for c in range(128)] + [0] * 128, np.uint8)
        self._points = np.full(0x110000, 255, np.uint8)

    def _kind(self, char: str) -> int:
        for some, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._rule.pre_tokenize_str(some + char)) == 1:
                named = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": RV, "v": RV, "l": LL, "e": EE, "'": QUOTE}
                return named.get(char, kind)
        return BLANK if char == " " else WHITE

    def _symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters and the byte at which each begins."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead]
        symbols = self._ascii[first]
        wide = np.flatnonzero(first >= 0xC0)
        if len(wide):
            at, head = lead[wide], first[wide].astype(np.int64)
            tail = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F
            two, three = (head & 0x1F) << 6 | tail(1), (head & 0x0F) << 12 | tail(1) << 6 | tail(2)
            four = (head & 0x07) << 18 | tail(1) << 12 | tail(2) << 6 | tail(3)
            points = np.where(head < 0xE0, two, np.where(head < 0xF0, three, four))
            kinds = self._points[points]
            for point in np.unique(points[kinds == 255]).tolist():
                self._points[point] = self._kind(chr(point))
            symbols[wide] = self._points[points]
        return symbols, lead

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces, special strings being one piece each, and n + 1 offsets."""
        symbols, lead = self._symbols(data)
        # An end symbol goes before the first character of each text.
        first = np.searchsorted(lead, offsets[:-1])
        places = first + np.arange(len(first))
        all_symbols = np.empty(len(symbols) + len(first), np.uint8)
        own = np.ones(len(all_symbols), bool)
        own[places] = False
        all_symbols[places] = END
        all_symbols[own] = symbols
        extra = []
        if self.special is not None:
            raw = data.tobytes()
            for found in self.special.finditer(raw):
                here = int(np.searchsorted(offsets, found.start(), "right")) - 1
                if found.end() <= offsets[here + 1]:
                    extra.append(found.start())
                    low, high = np.searchsorted(lead, [found.start(), found.end()])
                    all_symbols[low + here + 1 : high + here + 1] = END
        marks = run_splitter(np.append(all_symbols, np.uint8(END)))
        begins = (marks[:-1] & HERE).astype(bool)
        begins |= (marks[1:] & BEFORE).astype(bool)
        begins = begins[own]
        if extra:
            begins[np.searchsorted(lead, extra)] = True
        starts = lead[begins]
        ends = np.append(starts, len(data))[1:] if len(starts) else starts
        return starts, ends, np.searchsorted(starts, offsets)


def byte_of_char() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merger:
    """The transducer of one BPE. ``max_states``: beyond this number all states are given up and built
    anew, which bounds memory and changes no count. ``stretch``: bytes of a chunk of a longer piece."""

    def __init__(self, path: str, max_states: int = 300_000, stretch: int = STRETCH):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE can be compiled")
        byte = byte_of_char()
        raw = {token: bytes(byte[c] for c in token) for token in model["vocab"] if all(c in byte for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ids: dict[bytes, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.rank: list[int] = []
        self.merge: dict[tuple[int, int], int] = {}
        for one in range(256):
            self.ids[bytes([one])] = one
            self.parts.append(None)
            self.rank.append(-1)
        for rank, (left, right) in enumerate(merges):
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            joined = raw[left] + raw[right]
            if joined not in self.ids:
                self.ids[joined] = len(self.parts)
                self.parts.append((a, b))
                self.rank.append(rank)
            self.merge.setdefault((a, b), rank)
        self.growing = {token[:k] for token in self.ids for k in range(1, len(token))}
        self._fits: dict[tuple[int, int], bool] = {}
        self.max_states, self.stretch = max_states, stretch
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [(b"", ((-1, 0),))]
        self.known = {self.states[0]: 0}
        self.memo = Memo()
        self.to, self.change = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.moves = 0

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens. The merges that made them are undone from
        the last; a merge across their border must never come before one that closes it."""
        key = left, right
        if (known := self._fits.get(key)) is not None:
            return known
        closed, fits = len(self.merge) + 1, True
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < closed:
                fits = False
                break
            if self.rank[left] < 0 and self.rank[right] < 0:
                break
            # Equal merges happen from the left on: one across the border would come after the left
            # token's and before the right token's.
            if self.rank[left] > self.rank[right]:
                closed = self.rank[left]
                left = self.parts[left][1]
            else:
                closed = self.rank[right] + 1
                right = self.parts[right][0]
        self._fits[key] = fits
        return fits

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        text, ends = self.states[state]
        text += bytes((byte,))
        token, count = byte, ends[-1][1] + 1
        for k in range(len(text)):
            # ends[j] is the last token, and the relative count, before text[j].
            found = self.ids.get(text[k:])
            if found is not None and (ends[k][0] < 0 or self.fits(ends[k][0], found)):
                token, count = found, ends[k][1] + 1
                break
        ends = (*ends, (token, count))
        while text and text not in self.growing:
            text, ends = text[1:], ends[1:]
        new = text, tuple((t, c - count) for t, c in ends)
        number = self.known.get(new)
        if number is None:
            number = self.known[new] = len(self.states)
            self.states.append(new)
        return number, count

    def _build(self, keys: np.ndarray) -> np.ndarray:
        """New transitions, by state * 256 + byte + 1."""
        pairs = [self._step((key - 1) >> 8, (key - 1) & 255) for key in keys.tolist()]
        while self.moves + len(pairs) > len(self.to):
            self.to, self.change = np.append(self.to, np.zeros_like(self.to)), np.append(self.change, np.zeros_like(self.change))
        numbers = np.arange(self.moves, self.moves + len(pairs))
        self.to[numbers], self.change[numbers] = [p[0] for p in pairs], [p[1] for p in pairs]
        self.moves += len(pairs)
        self.memo.add(keys, numbers)
        return numbers

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece; all pieces, and the chunks of long ones, run side by side."""
        if len(self.states) > self.max_states:
            self._reset()
        out = np.empty(len(starts), np.int64)
        long = ends - starts > self.stretch
        out[~long], _ = self._run(data, starts[~long], ends[~long], np.zeros(int((~long).sum()), np.int64))
        if long.any():
            out[long] = self._composed(data, starts[long], ends[long])
        return out

    def _composed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of long pieces. ``known``: chunk and entered state of what has run, in
        one number each; with it the state at its end and its tokens."""
        chunks = -(-(ends - starts) // self.stretch)
        first = np.cumsum(chunks) - chunks
        piece = np.repeat(np.arange(len(starts)), chunks)
        low = starts[piece] + (np.arange(len(piece)) - first[piece]) * self.stretch
        high = np.minimum(low + self.stretch, ends[piece])
        last = np.append(piece[1:] != piece[:-1], True)
        known, left, tokens = (np.zeros(0, np.int64) for _ in range(3))
        new, rounds = np.arange(len(piece)) << 32, 0
        while True:
            count, to = self._run(data, low[new >> 32], high[new >> 32], new & 0xFFFFFFFF)
            known, left, tokens = np.append(known, new), np.append(left, to), np.append(tokens, count)
            order = np.argsort(known)
            known, left, tokens = known[order], left[order], tokens[order]
            after = ((known >> 32) + 1) << 32 | left
            place = np.minimum(np.searchsorted(known, after), len(known) - 1)
            on = ~last[known >> 32]
            met = on & (known[place] == after)
            # The scan: each doubling joins what has run with what follows it.
            turn, total = np.where(met, place, np.arange(len(known))), np.where(met, tokens, 0)
            for _ in range(int(chunks.max()).bit_length()):
                total, turn = total + total[turn], turn[turn]
            heads = np.searchsorted(known, first << 32)
            open_ = on & ~met
            rounds += 1
            if rounds > GUESSES:
                reached = np.zeros(len(known), bool)
                reached[turn[heads]] = True
                open_ &= reached
            new = np.unique(after[open_])
            if not len(new):
                return total[heads] + tokens[turn[heads]]

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens that each stretch adds to the state it is entered in, and the state at
        its end."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(starts), np.int64)
        state, begin, size = entry[order].astype(np.int64), starts[order], size[order]
        active, at = len(starts), 0
        while active:
            active = int(np.searchsorted(-size, -at, "left"))
            if not active:
                break
            keys = (state[:active] << 8 | data[begin[:active] + at]).astype(np.uint64) + np.uint64(1)
            move = self.memo.find(keys).astype(np.int64)
            missing = np.flatnonzero(move < 0)
            if len(missing):
                new, inverse = np.unique(keys[missing], return_inverse=True)
                move[missing] = self._build(new)[inverse]
            state[:active] = self.to[move]
            out[:active] += self.change[move]
            at += 1
        back, final = np.empty_like(out), np.empty_like(state)
        back[order], final[order] = out, state
        return back, final


class TokenCounter:
    """Counts of tokens per text. Counts of pieces are kept in a table that starts anew beyond
    ``max_pieces``."""

    def __init__(self, path: str, max_pieces: int = 3_000_000):
        self.splitter, self.merger, self.max_pieces = Splitter(path), Merger(path), max_pieces
        self.pieces = Memo()

    def _seed(self) -> None:
        self.pieces = Memo()
        if self.splitter.added:
            data, offsets = text_bytes(pa.array(self.splitter.added))
            self.pieces.add(fingerprints(data, offsets[:-1], offsets[1:]), np.ones(len(self.splitter.added)))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.pieces.size == 0 or self.pieces.size > self.max_pieces:
            self._seed()
        starts, ends, at = self.splitter.pieces(data, offsets)
        prints = fingerprints(data, starts, ends)
        counts = self.pieces.find(prints)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            new, place = first_of_each(prints[missing])
            where = missing[place]
            self.pieces.add(new, self.merger.counts(data, starts[where], ends[where]))
            counts[missing] = self.pieces.find(prints[missing])
        return per_text(counts.astype(np.int64), at)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled counter per Python worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]
