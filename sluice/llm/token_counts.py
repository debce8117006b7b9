"""Operator 8: token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary is compiled to a deterministic transducer. Its state after a prefix holds, for each
start from which a longer vocabulary entry may still run, the entry's trie node, the last token before that
start and the tokens counted there; reading a byte moves to the next state and emits the change of the count.
Adjacent tokens must be a pair that BPE itself would leave apart, which makes the last token of every prefix
unique. States and transitions are made when first met and kept.

The map of a stretch of bytes is what it does to the transducer: state before it -> (state after it, tokens emitted). Maps
compose associatively and are scanned. Texts are cut at safe cuts, where the tokenizer's pattern surely ends one pre-token and
begins another: before a space between two characters that aren't white space, and between letters, digits and marks. A piece
between safe cuts takes the start state to the start state, so its map is one count (kept for pieces that come again) and
scanning is adding. A pre-token longer than CHUNK_BYTES is cut into chunks; each chunk's map is made for the state that the
LOOK_BACK bytes before it lead to, maps are composed pairwise in a tree, and one that is asked for another state reads its
chunk from there, so that counts are exact and long texts without spaces take linear time.

Defined results: null and empty texts have 0 bytes and 0 tokens; the special string counts as its one token,
the library's default; repeated rows each give a row.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, memo

CHUNK_BYTES, LOOK_BACK, LIMIT_TOKENS = 1 << 12, 1 << 8, 512
#: Entries of the memo of words and of the transition table; when full they start anew.
MEMO, TRANSITIONS = 700_000, 800_000
#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: ASCII marks that the pattern never joins to a word before them.
_MARKS = ".,!?;:#%&$*"
#: Safe cuts. A mark ' is none before a letter, for it may begin a contraction.
SAFE = r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
#: Characters of a piece that is kept, at most; longer ones hardly come again.
KEPT_CHARS = 64


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: Latin-1's printable characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = iter(range(256, 512))
    return {chr(b if b in own else next(others)): b for b in range(256)}


class Transducer:
    """Lazily determinised BPE transducer. ``count(word)`` runs it over one pre-token's bytes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        symbols = byte_symbols()
        raw = {t: bytes(symbols[c] for c in t) for t in vocab if all(c in symbols for c in t)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            self.rank[raw[a], raw[b]] = r
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in raw.values():
            at = 0
            for b in t:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                at = nxt
            self.token[at] = t
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.ids, self.move = [START], {START: 0}, {}

    def bpe(self, word: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stands(self, last: bytes, token: bytes) -> bool:
        """Whether BPE leaves the two tokens apart and whole."""
        got = self.pairs.get((last, token))
        if got is None:
            if len(self.pairs) > TRANSITIONS:
                self.pairs.clear()
            got = self.pairs[last, token] = self.bpe(last + token) == ([last, token] if last else [token])
        return got

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        found, kept = None, []
        for node, last, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token is not None and self.stands(last, token):
                found = token, count + 1
            if self.children[child]:
                kept.append((child, last, count))
        token, emitted = found
        new = (*((c, last, n - emitted) for c, last, n in kept), (0, token, 0))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        self.move[state << 8 | byte] = (to, emitted)
        return to, emitted

    def run(self, start: tuple, word: bytes) -> tuple[tuple, int]:
        """The map of a word at one state: (state after it, tokens emitted)."""
        if len(self.move) > TRANSITIONS:
            self._reset()
        state, total = self.ids.get(start), 0
        if state is None:
            state = self.ids[start] = len(self.states)
            self.states.append(start)
        move = self.move
        for b in word:
            at = move.get(state << 8 | b)
            state, emitted = at if at is not None else self._step(state, b)
            total += emitted
        return self.states[state], total

    def count(self, word: bytes) -> int:
        if len(word) <= CHUNK_BYTES:  # one chunk from the start state: only its count is wanted
            if len(self.move) > TRANSITIONS:
                self._reset()
            state = total = 0
            move = self.move
            for b in word:
                at = move.get(state << 8 | b)
                state, emitted = at if at is not None else self._step(state, b)
                total += emitted
            return total
        maps: list[StateMap] = []
        for i in range(0, len(word), CHUNK_BYTES):
            m = StateMap(lambda s, part=word[i : i + CHUNK_BYTES]: self.run(s, part))
            m(self.run(START, word[max(0, i - LOOK_BACK) : i])[0])  # every chunk on its own
            maps.append(m)
        while len(maps) > 1:  # the scan's up-sweep
            maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0](START)[1]


#: The state before a pre-token: one open entry at the trie's root, no token before it.
START = ((0, b"", 0),)


class StateMap(dict):
    """state -> (state, count) for the states asked for so far."""

    def __init__(self, at):
        super().__init__()
        self.at = at

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        got = self.get(state)
        if got is None:
            got = self[state] = self.at(state)
        return got


def compose(first: StateMap, then: StateMap) -> StateMap:
    """The map of two stretches in a row, at the states that the first one has."""

    def at(state):
        middle, n = first(state)
        end, m = then(middle)
        return end, n + m

    out = StateMap(at)
    for state in list(first):
        out(state)
    return out


class _Words(dict):
    """Tokens of ' ' + word for words between spaces; -1 for one that a cut beside it isn't safe for."""

    def __init__(self, segment):
        super().__init__()
        self.segment = segment

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        if not word or word[0].isspace() or word[-1].isspace():
            n = -1
        else:
            core = word.rstrip(_MARKS)
            # a run of marks after a letter or digit is a pre-token of its own
            n = self[core] + self.segment(word[len(core) :]) if core and core != word and core[-1].isalnum() else self.segment(" " + word)
        if len(word) <= KEPT_CHARS:
            self[word] = n
        return n


class Counter:
    """Counts a whole text's tokens as the library does for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pretokens, self.cut = regex.compile(PATTERN).findall, regex.compile(SAFE).split
        self.words = _Words(self.segment)

    def segment(self, text: str) -> int:
        return sum(self.transducer.count(p.encode()) for p in self.pretokens(text))

    def plain(self, text: str) -> int:
        words = text.split(" ")
        if len(words) > 2:
            counts = list(map(self.words.__getitem__, words[1:-1]))
            if min(counts) >= 0 and words[0] and words[-1] and not words[0][-1].isspace() and not words[-1][0].isspace():
                return self.segment(words[0]) + sum(counts) + self.segment(" " + words[-1])
        return sum(map(self.segment, self.cut(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.split_special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def counter(path: str) -> Counter:
    """The compiled tokenizer of a vocabulary file, once a worker."""
    return memo(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_TOKENS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row. vocabulary: path of a byte-level BPE .json file."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(b):
        c = counter(vocabulary)
        texts = b.column(1).to_pylist()
        n = [c.count(t) for t in texts]
        size = [len(t) if t.isascii() else len(t.encode()) for t in (t or "" for t in texts)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")), run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
