"""BPE by a tokenization automaton.

The merges are compiled, one gadget after another in order of rank, into a deterministic automaton over tokens whose paths
are exactly the token sequences that the merges make. It starts with one state and a loop for each base symbol. The
gadget of a merge (a, b) -> c takes b out of what may follow a, and lets c stand wherever a could, with what may follow b
as its successors. So the state after a token is a view of its last part's state at the time of the merge, less what later
merges took out; states are kept as such views: a parent, the time of the view, and the tokens taken out with their times.

That automaton is made deterministic over base symbols by the subset construction: a state is the set of the tokens that
have begun, each with the state it began in. Its transitions are stored in a table as they are first taken, with the token
that ends there. A word is encoded by one look-up for each symbol; the arcs taken, read back from the end, are its tokens.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tracemill.llm.common import parts

#: Fixed: white space as Unicode defines it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_NOT_WHITE = regex.compile(f"[^{WHITE}]+")
#: Distinct chunks of text, words, and transitions that a worker remembers; beyond it starts anew.
CACHE = 150_000


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


class Recent:
    """What was asked for of late: two tables of at most ``most`` entries; the older goes when the newer is full."""

    def __init__(self, most: int = CACHE):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Automaton:
    """The merge automaton of a vocabulary (token -> id) and its merges in order of rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values()) + 1
        self.forever = len(merges) + 1
        self.first, self.second = [-1] * size, [-1] * size  # the parts of a token
        self.born = [0] * size  # the time of its gadget; 0: a base symbol
        self.taken: dict[int, int] = {}  # (a, b) -> the time when b was taken out of a's successors
        self.width = size
        for time, (x, y) in enumerate(merges, 1):
            self._gadget(time, vocabulary[x], vocabulary[y], vocabulary[x + y])
        self.labels = [""] * size
        for token, i in vocabulary.items():
            self.labels[i] = token
        self.arcs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        self.taken.setdefault(a * self.width + b, time)
        if self.born[c] == 0:
            self.first[c], self.second[c], self.born[c] = a, b, time

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for another."""
        key = state * self.width + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > 4 * CACHE:
                self.arcs.clear()
            found = self.arcs[key] = self._resolve(state, token)
        return found

    def _resolve(self, a: int, b: int) -> bool:
        """Walks the views back: the pair of parts that meet must not have been merged while both were there."""
        taken, first, second, born, width = self.taken, self.first, self.second, self.born, self.width
        until = self.forever
        while True:
            at = taken.get(a * width + b)
            if at is not None and at < until:
                return False
            # undo the later of the two gadgets; the parts that met before it are those next to the border
            if born[a] > born[b]:
                # c = (x, a') came to be at born[a]; before, a' met b; after that time nothing may have joined b to a'
                until = min(until, born[a])
                a = second[a]
            elif born[b]:
                # at the same time counts too: of three equal parts the merge takes the two on the left
                until = min(until, born[b] + 1)
                b = first[b]
            else:
                return True


    def made(self, token: int) -> bool:
        """Whether the merges make the token from its own symbols: its parts are the path of its own text."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.born[token] == 0 or (self.made(self.first[token]) and self.made(self.second[token]) and self._together(token))
        return found

    def _together(self, token: int) -> bool:
        """The two parts can stand side by side until the token's own gadget."""
        a, b = self.first[token], self.second[token]
        at = self.taken.pop(a * self.width + b)
        fits = at == self.born[token] and self._resolve(a, b)
        self.taken[a * self.width + b] = at
        return fits


class Transitions:
    """The automaton over base symbols: numbered states, and the table (state, symbol) -> next state and the token that ends.

    At any place of a word exactly one token ends on the path from the start, or none does yet. A symbol is a byte, or 256
    more for a byte that ends a word.
    """

    def __init__(self, auto: Automaton, tokens: dict[int, list[int]], most: int = 2 * CACHE):
        self.auto, self.most = auto, most
        self.child: dict[int, int] = {}
        self.ends, self.sizes = [-1], [0]  # of each node of the tokens' prefix tree: its token, its depth
        for token, symbols in tokens.items():
            at = 0
            for x in symbols:
                key = at * 512 + x
                at = self.child.get(key, 0)
                if not at:
                    at = self.child[key] = len(self.ends)
                    self.sizes.append(self.sizes[key // 512] + 1)
                    self.ends.append(-1)
            self.ends[at] = token
        self.inner = bytearray(len(self.ends))  # whether a longer token goes on from the node
        for key in self.child:
            self.inner[key // 512] = 1
        self._start()

    def _start(self) -> None:
        #: Each state's pairs (node of a begun token, token before it plus 1, or 0), and the number of each such set.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int, int]] = {}

    def step(self, state: int, symbol: int) -> tuple[int, int, int]:
        """Works out a transition and stores it: the next state, the token that ends here (-1: none) and its size."""
        token, size, begun = -1, 0, []
        child, ends, inner, auto, before_bits = self.child, self.ends, self.inner, self.auto, (1 << 20) - 1
        for pair in self.states[state]:
            node = child.get((pair >> 20) * 512 + symbol)
            if node is None:
                continue
            before = pair & before_bits
            if inner[node]:
                begun.append(node << 20 | before)
            if token < 0:
                end = ends[node]
                if end >= 0 and auto.made(end) and (not before or auto.arc(before - 1, end)):
                    token, size = end, self.sizes[node]
        if token >= 0:
            begun.append(token + 1)
        reached = tuple(begun)
        number = self.numbers.get(reached)
        if number is None:
            number = self.numbers[reached] = len(self.states)
            self.states.append(reached)
        found = self.table[state * 512 + symbol] = number, token, size
        return found

    def path(self, symbols: Iterable[int]) -> list[int]:
        """The tokens on the path that reads the symbols."""
        if len(self.table) > self.most:
            self._start()
        state, tokens, sizes, get = 0, [], [], self.table.get
        for x in symbols:
            state, token, size = get(state * 512 + x) or self.step(state, x)
            tokens.append(token)
            sizes.append(size)
        out, i = [], len(tokens) - 1
        while i >= 0:
            out.append(tokens[i])
            i -= sizes[i]
        out.reverse()
        return out


class WordBpe:
    """A tokenizer file with word ends, read as data: NFC, lower case, its split pattern, byte symbols, and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocabulary = model["vocab"]
        self.auto = Automaton(self.vocabulary, merges)
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = list(self.auto.labels)
        for text, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = text
        self.label_table = np.array(self.labels, object)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        tokens = {i: x for token, i in self.vocabulary.items() if (x := self._symbols(token, byte_of))}
        self.transitions = Transitions(self.auto, tokens)
        self.forget()

    def forget(self) -> None:
        """Gives back what has been remembered: workers live on with other work."""
        self.chunks, self.words = Recent(), Recent()
        self.transitions._start()
        self.auto.arcs = {}

    def _symbols(self, token: str, byte_of: dict[str, int]) -> list[int] | None:
        """The token's base symbols; none if it has others, as the special ones may."""
        last = token.endswith(self.end) and len(token) > len(self.end)
        found = [byte_of.get(c, -1) for c in (token[: -len(self.end)] if last else token)]
        if -1 in found:
            return None
        return [*found[:-1], found[-1] + 256] if last else found

    def encode_word(self, word: str) -> bytes:
        """The only path of the automaton that reads the word."""
        raw = word.encode()
        ids = array("I", self.transitions.path([*raw[:-1], raw[-1] + 256]))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        """A run without white space."""
        out = []
        if chunk.isascii():
            low = chunk.lower()
            found = [low] if low.isalpha() else self.pattern.findall(low)
        else:
            found = self.pattern.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        for word in found:
            ids = self.words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= 64:
                    self.words.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if "<" in text and (parts := self.specials.split(text)) and len(parts) > 1:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        recent, out = self.chunks, []
        for chunk in _NOT_WHITE.findall(text) if not text.isascii() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else text.split():
            ids = recent.new.get(chunk) or recent.get(chunk)
            if ids is None:
                ids = self.encode_chunk(chunk)
                if len(chunk) <= 64:
                    recent.put(chunk, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The arc labels of the path; a file without a decoder joins them with spaces."""
        return " ".join(self.label_table[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def bpe(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """docs' other columns with token_ids (array of int) and decoded_text, for text as the tokenizer file has it.

    docs: doc_id, text, and any other columns, which stay, unless named like an added one, which replaces it. A null or
    empty text has no tokens and decodes to the empty text. Texts are read whole, in the order of their white-space
    chunks. The file is read on the driver and shipped with the job.
    """
    return _run(docs, path, digests=False, decode=decode)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """As bpe(), with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the decoded text."""
    return _run(docs, path, digests=True, decode=True)


def _run(docs: DataFrame, path: str, digests: bool, decode: bool) -> DataFrame:
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["token_ids", "decoded_text"]
    own = [c for c in docs.columns if c not in added and (c != "text" or not digests)]
    base = docs.select(*own, "text") if digests else docs.select(*own)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(SparkFiles.get(name))
        for part in parts(batches, 500):
            kept = part.columns[: len(own)]
            counts, a, b = [], [], []
            for text in part.column(at).to_pylist():
                ids = t.encode(text or "")
                words = t.decode(ids) if decode else None
                counts.append(len(ids) // 4)
                if digests:
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(words.encode()).hexdigest())
                else:
                    a.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    b.append(words)
            columns = [pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] if digests else [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*own, *added])
        t.forget()

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(own)]]
    kinds = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["token_ids array<int>", "decoded_text string"]
    return base.mapInArrow(run, ", ".join([*names, *kinds]))


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_path())
