"""Languages of documents and of their paragraphs, by prediction by partial matching.

One byte context tree per language is trained on a bounded sample of labelled rows and then frozen. A byte is
coded in the longest context (up to `order` bytes back) in which it was seen; each shorter context costs
an escape, whose probability is ``d / (n + d)`` for a context seen `n` times with `d` different successors;
below the empty context all bytes are equally likely. Contexts begin at the space in front of a word, so the
code length of a word does not depend on its neighbours and is worked out once per worker.

The paragraphs (blocks of lines between blank lines) of a document get the language with the shortest code; the
document's is that of most of its words. Sample rows may be labelled wrongly: after a first training their paragraphs
are judged by the first trees, and the final trees are trained on the paragraphs' judged languages.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.runtime import per_process, spread

# The languages and how labels spell them.
LANGUAGES = {
    "en": ["eng", "english"], "de": ["deu", "ger", "german", "deutsch"], "fr": ["fra", "fre", "french", "français", "francais"],
    "es": ["spa", "spanish", "español", "espanol", "castellano"], "it": ["ita", "italian", "italiano"],
    "pt": ["por", "portuguese", "português", "portugues"], "nl": ["nld", "dut", "dutch", "nederlands"], "sv": ["swe", "swedish", "svenska"],
}

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass(frozen=True)
class LanguageControl:
    """Parameters. `sample` bounds the labelled rows on which the trees are trained (chosen by a hash of the
    id over the whole table); everything else covers all rows."""

    sample: int = 2_000
    order: int = 4
    least_words: int = 8
    paragraph_words: int = 4
    paragraph_bits: float = 30.0


def named_language(label: str | None) -> str | None:
    """The two-letter code that a label names in any spelling; None if it names none of the languages."""
    low = (label or "").strip().lower()
    head = re.split(r"[-_]", low)[0]
    for code, names in LANGUAGES.items():
        if head == code or low in names or head in names:
            return code
    return None


def paragraphs(text: str) -> list[str]:
    """The blocks of lines between blank lines."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in _BLANK.split(plain.strip()) if p.strip()] if plain.strip() else []


def words_of(text: str) -> list[str]:
    """The words, composed and in lower case."""
    return _TOKEN.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


class Trees:
    """Frozen context trees of all languages."""

    def __init__(self, counts: dict[str, Counter], order: int):
        self.codes, self.order = list(counts), order
        self.trees: list[dict[bytes, dict[int, int]]] = []
        for words in counts.values():
            tree: dict[bytes, dict[int, int]] = {}
            for word, many in words.items():
                data = b" " + word.encode("utf-8", "replace") + b" "
                for i in range(1, len(data)):
                    for k in range(min(order, i) + 1):
                        successors = tree.setdefault(data[i - k : i], {})
                        successors[data[i]] = successors.get(data[i], 0) + many
            self.trees.append(tree)
        # Frozen: code length of each seen byte, and of the escape, per context.
        self.costs = [{c: (math.log2((n := sum(s.values())) + len(s)) - math.log2(len(s)), {b: math.log2((n + len(s)) / k) for b, k in s.items()}) for c, s in tree.items()} for tree in self.trees]
        del self.trees

    def bits(self, context: bytes, byte: int) -> list[float]:
        """Code length of `byte` behind `context`, per language."""
        contexts = [context[k:] for k in range(len(context) + 1)]
        out = []
        for costs in self.costs:
            cost = 0.0
            for c in contexts:
                known = costs.get(c)
                if known is not None:
                    seen = known[1].get(byte)
                    if seen is not None:
                        cost += seen
                        break
                    cost += known[0]
            else:
                cost += 8.0
            out.append(cost)
        return out


class Scorer:
    """Code lengths of tokens (stretches without white space) under frozen trees, kept per token and per context."""

    def __init__(self, trees: Trees, most: int = 200_000):
        self.trees, self.most = trees, most
        self._clear()

    def _clear(self) -> None:
        width = len(self.trees.codes)
        self.rows: dict[bytes, int] = {}
        self.grams = np.zeros((1024, width), np.float32)
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((1024, width + 1), np.float32)  # the last column counts words

    def _learn(self, tokens: list[str]) -> None:
        """Code lengths of tokens that were not seen before, all at once."""
        order, rows, known, bits = self.trees.order, self.rows, self.known, self.trees.bits
        flat: list[int] = []
        ends, words, fresh = [], [], []
        for token in tokens:
            parts = words_of(token)
            for word in parts:
                data = b" " + word.encode("utf-8", "replace") + b" "
                for i in range(1, len(data)):
                    gram = data[i - order if i > order else 0 : i + 1]
                    row = rows.get(gram)
                    if row is None:
                        row = rows[gram] = len(rows)
                        fresh.append(bits(gram[:-1], gram[-1]))
                    flat.append(row)
            ends.append(len(flat))
            words.append(len(parts))
        if fresh:
            while len(rows) > len(self.grams):
                self.grams = np.concatenate([self.grams, np.zeros_like(self.grams)])
            self.grams[len(rows) - len(fresh) : len(rows)] = fresh
        first = len(known)
        known.update(zip(tokens, range(first, first + len(tokens))))
        while len(known) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        at = np.arange(first, len(known))
        self.matrix[at, -1] = words
        begin = np.r_[0, ends[:-1]]
        some = np.flatnonzero(np.array(words))
        if len(some):
            self.matrix[at[some], :-1] = np.add.reduceat(self.grams[np.array(flat)], begin[some])

    def blocks(self, blocks: list[list[str]]) -> np.ndarray:
        """Code length of each block of tokens per language, and (last column) its number of words."""
        if len(self.known) > self.most:
            self._clear()
        known = self.known
        if new := {t for tokens in blocks for t in tokens if t not in known}:
            self._learn(list(new))
        at = [known[t] for tokens in blocks for t in tokens]
        sizes = np.array([len(b) for b in blocks])
        out = np.zeros((len(blocks), self.matrix.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.matrix[np.array(at)].astype(float), np.r_[0, np.cumsum(sizes[full])[:-1]])
        return out


def train(rows: list[tuple[str | None, str | None]], control: LanguageControl) -> Trees:
    """Trees from (label, text) rows: by label first, then by the judged language of each paragraph."""
    counts = {code: Counter() for code in LANGUAGES}
    blocks = []
    for label, text in rows:
        code = named_language(label)
        for part in paragraphs(text or ""):
            words = words_of(part)
            if code and len(words) >= control.least_words:
                counts[code].update(words)
                blocks.append(words)
    first = Trees(counts, control.order)
    cost = Scorer(first).blocks(blocks)[:, :-1]
    again = {code: Counter() for code in LANGUAGES}
    for words, bits in zip(blocks, cost):
        again[first.codes[int(np.argmin(bits))]].update(words)
    return Trees(again, control.order)


def judge(texts: list[str | None], scorer: Scorer, control: LanguageControl) -> list[tuple[int, int, int, float, int, int, int]]:
    """Rows (text, paragraph or 0, language, confidence, words, the text's language and words).

    Texts without words have none.

    A paragraph keeps the document's language unless its own code is clearly shorter.
    """
    parts = [[p.split() for p in paragraphs(t)] if t else [] for t in texts]
    measured = scorer.blocks([p for ps in parts for p in ps])
    cost, counted = measured[:, :-1], measured[:, -1].astype(np.int64)
    out, at = [], 0
    for n, ps in enumerate(parts):
        bits, size = cost[at : at + len(ps)], counted[at : at + len(ps)]
        at += len(ps)
        if not size.sum():
            continue
        best = np.argmin(bits, axis=1)
        total = bits.sum(axis=0)
        clear = size >= control.paragraph_words
        share = np.zeros(bits.shape[1])
        np.add.at(share, best[clear], size[clear])
        main = int(np.lexsort((total, -share))[0])
        own = np.where(clear & (bits[np.arange(len(ps)), main] - bits.min(axis=1) > control.paragraph_bits), best, main)
        ours = own == main
        words = int(size.sum())
        out.append((n, 0, main, _confidence(bits[ours].sum(axis=0), main), words, main, words))
        out += [(n, k + 1, int(own[k]), _confidence(bits[k], int(own[k])), int(size[k]), main, words) for k in range(len(ps))]
    return out


def _confidence(bits: np.ndarray, chosen: int) -> float:
    """The share of the chosen language if all are equally likely beforehand."""
    return float(1 / np.sum(np.exp2(np.clip(bits[chosen] - bits, -1000, 1000))))


def assign_languages(documents: DataFrame, control: LanguageControl | None = None) -> DataFrame:
    """Rows ``doc_id, para_no, lang, confidence, words, main, doc_words, label`` of every document (para_no 0) and
    paragraph; `main` and `doc_words` are the document's language and number of words.

    NULL, empty, blank and wordless texts have no row. `label` is the language that the row's own label names
    (NULL if none). Texts are read whole. Repeated documents keep their own rows. Extra columns are ignored.
    Without any labelled row the table cannot be judged and the result is empty.
    """
    c = control or LanguageControl()
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    spelt = [*LANGUAGES, *(n for names in LANGUAGES.values() for n in names)]
    labelled = F.split(F.lower(F.trim("lang")), "[-_]")[0].isin(spelt)
    chosen = [r[0] for r in base.where(labelled & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(c.sample).collect()]
    sample = [(r.lang, r.text) for r in base.where(F.col("doc_id").isin(chosen)).select("lang", "text").collect()] if chosen else []
    schema = "doc_id bigint, para_no bigint, lang string, confidence double, words bigint, main string, doc_words bigint, label string"
    if not sample:
        return documents.sparkSession.createDataFrame([], schema)
    trees = train(sample, c)
    token = uuid.uuid4().hex
    shared = documents.sparkSession.sparkContext.broadcast(trees)  # as large as the bounded sample's contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scorer = per_process(("languages", token), lambda: Scorer(shared.value))
            keys, labels, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), scorer.trees.codes
            found = []
            for a in range(0, batch.num_rows, 250):  # a few texts at a time are taken apart
                found += [(a + f[0], *f[1:]) for f in judge(batch.column(2).slice(a, 250).to_pylist(), scorer, c)]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([codes[f[2]] for f in found], pa.string()),
                pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.int64()), pa.array([codes[f[5]] for f in found], pa.string()), pa.array([f[6] for f in found], pa.int64()), pa.array([named_language(labels[f[0]]) for f in found], pa.string()),
            ], ["doc_id", "para_no", "lang", "confidence", "words", "main", "doc_words", "label"])

    return spread(base).mapInArrow(run, schema)


def wrong_labels(documents: DataFrame, control: LanguageControl | None = None) -> DataFrame:
    """Rows ``doc_id, para_no, lang``: labels that are missing or wrong (para_no 0) and paragraphs in another
    language than their document. Documents of fewer than `least_words` words have none."""
    c = control or LanguageControl()
    rows = assign_languages(documents, c).where(F.col("doc_words") >= c.least_words)
    return rows.where("(para_no = 0 and not (label <=> lang)) or (para_no > 0 and lang <> main)").select("doc_id", "para_no", "lang").distinct()
