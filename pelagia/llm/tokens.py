"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The automaton reads tokens: it accepts exactly the token sequences that byte-pair merging yields. It starts
with the 256 bytes, each allowed behind each. Every merge ``(u, v) -> w``, in order of rank, is applied as a
gadget: the arc `v` behind `u` is removed; the new state `w` gets the arcs that leave `v`; and each state with
an arc to `u` gets one to `w`. As a state is entered by arcs of one token only, the states are the tokens.

The full table has (vocabulary size) squared entries, 2.5 billion for 50,257 tokens, of which a corpus
touches few. Entries are therefore worked out when first needed, by undoing the gadgets from the last one
back (`follows`), and kept. A word is encoded by table-driven transitions along its bytes: each prefix has exactly
one accepted path, whose last arc is kept; reading the kept arcs backwards emits the ids. Decoding emits
the labels (byte strings) of the arcs.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.runtime import per_process, spread

#: Fixed value: the pre-splitting pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte string to id, from a ``.tiktoken`` file of ranks or a ``.json`` file of a byte-level tokenizer."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    return {bytes(back[c] for c in word): n for word, n in model["vocab"].items() if all(c in back for c in word)}


class Automaton:
    """The tokenization automaton of a vocabulary whose ids of merged tokens are in order of rank."""

    def __init__(self, ranks: dict[bytes, int], most: int = 2_000_000):
        self.ids, self.most = ranks, most
        self.label = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.starts = {b[:k] for b in ranks for k in range(1, len(b) + 1)}  # where a longer token may still come
        for word, i in sorted(ranks.items(), key=lambda x: x[1]):  # one gadget per merge, by rank
            if len(word) > 1 and (pair := self._pair(word, i)) is not None:
                self.parts[i] = pair
                self.merged[pair] = i

    def _pair(self, word: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is `word`: what byte-pair merging below `rank` leaves of it."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None  # unreachable by merges
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def follows(self, p: int, t: int) -> bool:
        """Whether token `t` may stand behind token `p`: the table's entry, worked out at first use. The table is bounded by itself."""
        found = self.table.get((p, t))
        if found is None:
            if len(self.table) >= self.most:
                self.table.clear()
            found = self.table[p, t] = self._unwind(p, t)
        return found

    def _unwind(self, p: int, t: int) -> bool:
        x, y, now = p, t, 1 << 60
        while True:
            gone = self.merged.get((x, y))
            if gone is not None and gone < now:  # a gadget removed the arc before the last undone one
                return False
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                return True
            # Undo the younger token's gadget: its state has the arcs of its second part, its arcs go where its first part's went.
            # The copy of a state is taken before its own gadget removes an arc, the copy of an arc after.
            if px is not None and x == y:
                now, x, y = x, px[1], py[0]
            elif py is None or (px is not None and x > y):
                now, x = x, px[1]
            else:
                now, y = y + 1, py[0]

    def encode(self, word: bytes) -> list[int]:
        """The ids of a pre-split word."""
        if (whole := self.ids.get(word)) is not None and (whole in self.parts or len(word) == 1):
            return [whole]
        n = len(word)
        last: list[int] = [-1] * (n + 1)  # of the accepted path of each prefix
        ids, follows, parts, starts = self.ids, self.follows, self.parts, self.starts
        for i in range(n):
            p = last[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = word[i:j]
                if piece not in starts:
                    break
                t = ids.get(piece)
                if t is not None and last[j] < 0 and (j == i + 1 or t in parts) and (i == 0 or follows(p, t)):
                    last[j] = t
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(self.label[last[j]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ids: the labels of its arcs."""
        return b"".join(self.label[i] for i in ids)


class Encoder:
    """Pre-splitting and encoding of texts, with bounded memory of what was seen."""

    def __init__(self, path: str, most: int = 300_000):
        import regex

        self.automaton = Automaton(vocabulary(path))
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most

    def piece(self, text: str) -> bytes:
        """The ids (as 32-bit integers) of a stretch of text that ends where pre-splitting must cut."""
        out: list[int] = []
        for word in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
                if len(self.words) >= self.most:
                    self.words.clear()
                if len(word) <= 64:
                    self.words[word] = ids
            out += ids
        return np.array(out, np.int32).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text. Pre-splitting always cuts before a single space between two characters that
        are no white space, so the text is taken apart there, and what repeats is looked up."""
        if not text:
            return b""
        pieces, out = self.pieces, []
        chunks: list[str] = []
        for k, part in enumerate(text.split(" ")):
            if k and (not part or part[0].isspace()):
                chunks[-1] += " " + part  # a run of white space is cut by its whole length
            else:
                chunks.append(" " + part if k else part)
        for chunk in chunks:
            ids = pieces.get(chunk)
            if ids is None:
                ids = self.piece(chunk)
                if len(pieces) >= self.most:
                    pieces.clear()
                if len(chunk) <= 64:
                    pieces[chunk] = ids
            out.append(ids)
        return b"".join(out)


def encode_corpus(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, ids`` (array of integers) of all documents, without special tokens.

    NULL and empty texts give an empty array; blank texts are encoded as they are; names of special tokens
    inside a text are ordinary text. Texts are encoded whole, whatever their length. Repeated documents
    and NULL keys keep their rows. Extra columns are ignored. No shuffle takes place, unless the
    table is read in fewer partitions than there are cores. `path` is the file of
    the vocabulary; it has to be readable on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = per_process(("encoder", path), lambda: Encoder(path))
            encoded = [encoder(t) for t in batch.column(1).to_pylist()]
            ends = np.r_[0, np.cumsum([len(e) // 4 for e in encoded])]
            flat = np.frombuffer(b"".join(encoded), np.int32)
            for a in range(0, len(encoded), 1024):  # offsets of a batch are 32 bits wide
                b = min(a + 1024, len(encoded))
                lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(flat[ends[a] : ends[b]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    return spread(documents.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))).mapInArrow(run, f"{key} bigint, ids array<int>")
