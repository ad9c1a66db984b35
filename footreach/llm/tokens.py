"""Token counts by a compiled finite-state tokenizer.

Compilation (once per Python worker, from the vocabulary file of a byte-pair tokenizer with word ends):

* The splitter is one pattern over explicit character classes; white space always ends a word.
* Inside a word the merges become a deterministic weighted transducer over bytes. A sequence of tokens is the merge
  result of its bytes exactly if each neighbouring pair is the merge result of its own bytes, so each prefix of a word has
  one last token, found among the tokens that end there and fit the last token of the prefix before them. A state is what
  later bytes can still ask for: for every place where a token may have begun, the node of the vocabulary's trie, the last
  token before it and the count there, relative to the count now. A transition carries the tokens it adds (a later byte
  can also join tokens, then it is 0 or less); a second kind of transition ends the word. States are made when first
  reached and kept; the table is emptied when it holds `MAX_STATES`, inside a word too, but for the state the word is in.
  Counts of whole words are kept in the same way, those of very long ones are not.

A text is cut into chunks of `CHUNK_CHARS`. The map of a chunk is (head, count, tail): an open word coming in is closed by
the head, the chunk emits `count` tokens, the tail stays open; a chunk without white space is one open piece. Maps compose
associatively, so the counts up to every chunk are a parallel prefix scan in log2(chunks) steps (`scan`); a text's count is
its last map, which is reduced pair by pair, so no prefix is kept. What differs from a map of transducer states: between
chunks an open word is carried as its characters, as the splitter decides at its end whether it is one word, and the
transducer reads it when it closes.

Defined cases: null texts are empty and have 0 bytes and 0 tokens; the special strings of the file inside a text are one
token each, as the library has it by default; repeated rows and other columns are no matter. No shuffle.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from footreach.llm.batches import small_batches

CHUNK_CHARS, MAX_STATES, MAX_FITS, MAX_WORDS, LONG_WORD, TOKEN_LIMIT = 16_384, 80_000, 200_000, 200_000, 256, 2048
#: Unicode White_Space.
SPACES = "\t-\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{SPACES}]")
_LAST_SPACE = re.compile(f".*[{SPACES}]", re.DOTALL)


def _ranges(category: str, top: int) -> str:
    """A character class of all code points up to `top` of a general category, as ranges."""
    points = "".join(map(chr, range(top + 1)))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in regex.finditer(rf"\p{{{category}}}+", points))


def splitter(top: int) -> re.Pattern:
    """Words of texts whose code points go up to `top`: a class within one plane is a table lookup per character."""
    letter, number = _ranges("L", top), _ranges("N", top)
    return re.compile(f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{letter}{number}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of byte-level tokenizers: itself if printable, else 256 and up."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class Transducer:
    """Counts tokens of words; compiled from a vocabulary, its merges in order, and the mark of a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str) -> None:
        letters = byte_letters()
        self.first = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]  # letter (byte, or 256 + last byte) -> token
        parts = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(parts)}
        spelled: dict[int, tuple[int, ...]] = {t: (i,) for i, t in enumerate(self.first)}
        for a, b in parts:
            spelled[vocab[a + b]] = spelled[vocab[a]] + spelled[vocab[b]]
        self.spelled, self.trie, self.token, self.inner = spelled, {}, [-1], [False]  # by node: its token or -1, whether it goes on
        for t, word in spelled.items():
            if self.merged([self.first[x] for x in word]) != [t]:
                continue  # a token that merging never makes
            node = 0
            for x in word:
                self.inner[node] = True
                at = self.trie.get(node << 9 | x)
                if at is None:
                    at = self.trie[node << 9 | x] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = at
            self.token[node] = t
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.moves: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Merge by rank, leftmost first, until nothing merges."""
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            ids[i:i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def fit(self, before: int, token: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are merged together."""
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MAX_FITS:
                self.fits.clear()
            known = self.fits[key] = self.merged([self.first[x] for t in key for x in self.spelled[t]]) == [before, token]
        return known

    def _reached(self, state: tuple, letter: int) -> tuple[int, int, list]:
        """(last token, tokens, open starts) of the prefix that ends with this letter; tokens relative to the state's."""
        trie, last, total, alive = self.trie, -1, 0, []
        for node, before, n in state:
            at = trie.get(node << 9 | letter)
            if at is None:
                continue
            if self.inner[at]:
                alive.append((at, before, n))
            if last < 0 and (t := self.token[at]) >= 0 and (before < 0 or self.fit(before, t)):
                last, total = t, n + 1
        return last, total, alive

    def renew(self, state: int) -> int:
        """Empty the table but for one state, and give its new number."""
        keep = self.states[state]
        self.reset()
        number = self.numbers.get(keep)
        if number is None:
            number = self.numbers[keep] = len(self.states)
            self.states.append(keep)
        return number

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added) for a byte that doesn't end the word."""
        t, n, alive = self._reached(self.states[state], byte)
        after = (*((at, before, m - n) for at, before, m in alive), (0, t, 0))
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        self.moves[state << 8 | byte] = out = (number, n)
        return out

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for b in word[:-1]:
            step = moves.get(state << 8 | b)
            if step is None:
                if len(self.states) > MAX_STATES:
                    state = self.renew(state)
                    moves = self.moves
                step = self.move(state, b)
            state = step[0]
            total += step[1]
        key = state << 8 | word[-1]
        last = self.ends.get(key)
        if last is None:
            last = self.ends[key] = self._reached(self.states[state], 256 | word[-1])[1]
        return total + last


class Known(dict):
    """Results of a function of a string, kept for strings seen; emptied when it holds `limit`."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> int:
        if len(key) > LONG_WORD:
            return self.make(key)
        if len(self) >= self.limit:
            self.clear()
        n = self[key] = self.make(key)
        return n


class Tokenizer:
    """A compiled tokenizer file: special strings, normaliser (NFC, white space, lower case), splitter, transducer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE file with word ends and the normaliser NFC, white space, lower case is wanted")
        special = [re.escape(x["content"]) for x in said["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.pieces = [splitter(top) for top in (0x7F, 0xFFFF, sys.maxunicode)]
        self.words = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.known = Known(lambda w: self.words.count(w.encode("utf-8", "surrogatepass")), MAX_WORDS)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter has no final sigma
        return text.lower()

    def closed(self, text: str) -> int:
        """Tokens of normalised text whose ends are word ends."""
        wide = 0 if text.isascii() else 1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2
        return sum(map(self.known.__getitem__, self.pieces[wide].findall(text)))

    def chunk_map(self, chunk: str) -> tuple:
        """(head, count, tail) of a chunk with white space, (piece,) of one without."""
        first = _SPACE.search(chunk)
        if first is None:
            return (chunk,)
        last = _LAST_SPACE.match(chunk).end()
        return chunk[:first.start()], self.closed(chunk[first.start():last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if len(a) == 1 and len(b) == 1:
            return (a[0] + b[0],)
        if len(a) == 1:
            return a[0] + b[0], b[1], b[2]
        if len(b) == 1:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions: in every step each map takes in the one a power of two before it."""
        reach = 1
        while reach < len(maps):
            maps = [self.compose(maps[i - reach], m) if i >= reach else m for i, m in enumerate(maps)]
            reach *= 2
        return maps

    def reduced(self, maps: list[tuple]) -> tuple:
        """The composition of all maps, neighbours first: log2(maps) rounds that hold each map's text once."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, m: tuple) -> int:
        """Tokens when the text begins before the map and ends after it."""
        return self.closed(m[0]) if len(m) == 1 else self.closed(m[0]) + m[1] + self.closed(m[2])

    def segment(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        text = self.normal(text)
        if len(text) <= chunk_chars:
            return self.closed(text)
        return self.finish(self.reduced([self.chunk_map(text[i:i + chunk_chars]) for i in range(0, len(text), chunk_chars)]))

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if self.special is None or "<|" not in text:
            return self.segment(text, chunk_chars)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.segment(p, chunk_chars) for p in parts)


_COMPILED: dict[str, Tokenizer] = {}


def compiled(path: str) -> Tokenizer:
    """One machine per file and Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Tokenizer(path)
    return _COMPILED[path]


SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint"


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks: one row per row. `path`: the vocabulary file, on every machine."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for ids, texts in small_batches(batches):
            n = [machine.count(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                                              pa.array([x > limit for x in n], pa.bool_()), pa.array([-(-len(t or "") // CHUNK_CHARS) for t in texts], pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(count, SCHEMA)


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
