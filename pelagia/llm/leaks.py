"""Evaluation passages inside a corpus: a positional inverted index, stored by shards of documents.

Both sides are normalised alike (case, accents, punctuation, hyphens at line breaks, bracketed interruptions)
and cut into words, which are coded by a 32-bit hash.

1. The corpus is normalised once: each document's codes are kept in the shared folder, together with how often
   each code occurs. The frequencies of the items' terms over the whole corpus are summed from these.
2. Each task reads its documents in shards of about `shard_words` words and makes the postings (document,
   position) of every term that occurs in test items. For a test item, blocks of `block` words are looked up: from
   a block's rarest terms in the corpus, the offset-adjusted postings lists are intersected, the rarest ones first;
   two of three must agree on where the item would begin. As rarity is the corpus's, the rows do not depend on
   how the table is split.
3. Blocks that agree on a place (a word may have been split or joined between them) make a candidate, which is
   followed word by word in both directions: exact matches, and single altered words between matching ones. No
   posting leaves its task; only the matches do.

Test items are a stated query set. They are gathered in blocks of at most about `items_per_pass` items and
`chars_per_pass` characters, by a hash of their id; the driver holds one block at a time. Each block is held against
all documents, whose codes are not made again.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.runtime import cut, per_process, spread

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑­](?:[ \t\r]*\n\s*)?(?=\w)")
_WORDS = re.compile(r"[^\W_]+")


class _Fold(dict):
    """Characters to their base letter, made when first seen."""

    def __missing__(self, code: int) -> str | None:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        self[code] = base
        return base


_FOLD = _Fold()


def words_of(text: str | None) -> list[str]:
    """The words of a text, without case, accents, punctuation, hyphens and bracketed interruptions."""
    if not text:
        return []
    if "(" in text or "[" in text:
        before = None
        while before != text:  # from the inside out
            before, text = text, _BRACKETS.sub(" ", text)
    text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = text.translate(_FOLD)
    return _WORDS.findall(text.lower())


class _Codes(dict):
    """Words to their codes, with bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) - (1 << 31)
        return code


def code_documents(documents: DataFrame, least: int, words_at_once: int = 2_000_000) -> DataFrame:
    """Rows ``doc_id, codes`` of the documents that may hold a passage of `least` words, and rows with NULL doc_id, `codes` and
    their `many` occurrences in part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = per_process(("leak codes",), _Codes)
        seen: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            terms, many = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            at = pa.array([0, len(terms)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms)), pa.ListArray.from_arrays(at, pa.array(many.astype(np.int64)))], ["doc_id", "codes", "many"])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                keys, lists = [], []
                for key, text in zip(batch.column(0).slice(a, 500).to_pylist(), batch.column(1).slice(a, 500).to_pylist()):
                    words = words_of(text)
                    if len(words) >= least - 8:
                        keys.append(key)
                        lists.append([codes[w] for w in words])
                if not keys:
                    continue
                ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                flat = np.fromiter((c for x in lists for c in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.nulls(len(keys), pa.list_(pa.int64()))], ["doc_id", "codes", "many"])
                seen.append(flat)
                size += len(flat)
                if size >= words_at_once:
                    yield counts()
                    size = 0
        if seen:
            yield counts()

    return documents.mapInArrow(run, "doc_id bigint, codes array<int>, many array<bigint>")


def follow(item: list[int], doc: list[int], i: int, j: int) -> tuple[int, int, list[tuple[int, int]]]:
    """First and last item position of the match through ``item[i] == doc[j]``, and the altered words between: where
    each begins and the next matching word stands in the item.

    A single altered word may stand between two matching ones; it may also be missing, doubled, split in
    two or joined with its neighbour.
    """

    def walk(a, b) -> tuple[int, list[tuple[int, int]]]:
        x = y = reach = 0
        altered: list[tuple[int, int]] = []
        pending: list[tuple[int, int]] = []
        while x < len(a) and y < len(b):
            if a[x] == b[y] and a[x] >= 0:
                x, y = x + 1, y + 1
                reach, altered, pending = x, altered + pending, []
                continue
            if pending:
                break
            for dx, dy in ((1, 1), (1, 2), (2, 1), (1, 0), (0, 1)):
                if x + dx < len(a) and y + dy < len(b) and a[x + dx] == b[y + dy] >= 0:
                    x, y, pending = x + dx, y + dy, [(x, x + dx)]
                    break
            else:
                break
        return reach, altered

    right, more = walk(item[i:], doc[j:])
    left, fewer = walk(item[:i][::-1], doc[:j][::-1])
    return i - left, i + right - 1, [(i - b, i - a) for a, b in reversed(fewer)] + [(i + a, i + b) for a, b in more]


def longest_part(lo: int, hi: int, changed: list[tuple[int, int]], least: int, altered: float) -> tuple[int, int, int] | None:
    """Length, first item position and altered words of the longest part of a match that has at least `least` words and
    at most the share `altered` of altered ones. A part begins and ends at an altered word's neighbour or the match's end."""
    begins, ends = [lo, *(b for _, b in changed)], [*(a - 1 for a, _ in changed), hi]
    best = None
    for k, a in enumerate(begins):
        for m in range(len(ends) - 1, k - 1, -1):
            length = ends[m] - a + 1
            if length < least or (best and length <= best[0]):
                break
            if m - k <= altered * length:
                best = (length, a, m - k)
                break
    return best


class Index:
    """The postings of a shard of documents, for the terms of the test items."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, longest: int, rank: np.ndarray):
        """`words`: term numbers (-1: no term of an item) of all documents behind each other; `longest`: words of the longest
        test item; `rank`: of each term, the rarest in the corpus first."""
        # Documents lie behind each other with room between them, so an offset never leads into another one.
        self.longest = longest
        room = 2 * longest + 1
        self.begin = np.r_[0, np.cumsum(lengths + room)][:-1] + room
        self.words, self.rank = words, rank
        self.first = np.r_[0, np.cumsum(lengths)]
        place = np.repeat(self.begin - self.first[:-1], lengths) + np.arange(len(self.words))
        known = np.flatnonzero(self.words >= 0)
        order = known[np.argsort(self.words[known], kind="stable")]
        self.terms, at = np.unique(self.words[order], return_index=True)
        self.lists = dict(zip(self.terms.tolist(), np.split(place[order], at[1:])))
        self.none = np.zeros(0, np.int64)

    def places(self, item: list[int], block: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (document, place of the item's first word) on which at least two blocks agree."""
        hits = []
        lists = [self.lists.get(w, self.none) for w in item]
        for a in range(0, len(item) - block + 1, block):
            rare = sorted(range(a, a + block), key=lambda k: self.rank[item[k]])
            chosen: list[int] = []
            for k in rare:  # three different terms
                if item[k] not in [item[c] for c in chosen]:
                    chosen.append(k)
                if len(chosen) == 3:
                    break
            found = []
            for n, few in enumerate(chosen):  # the rarest first: its places are looked up in the longer lists
                for many in chosen[n + 1 :]:
                    short, long = lists[few], lists[many]
                    if len(short) and len(long):
                        at = np.searchsorted(long, short + (many - few))
                        found.append(short[long[np.minimum(at, len(long) - 1)] == short + (many - few)] - few)
            if found:
                hits.append(np.unique(np.concatenate(found)))
        if len(hits) < 2:
            return self.none, self.none
        place, many = np.unique(np.concatenate(hits), return_counts=True)
        near = many.copy()
        for k in (1, 2):  # a word split or joined between two blocks moves the rest by one
            for sign in (-k, k):
                at = np.searchsorted(place, place + sign)
                same = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == place + sign)
                near += np.where(same, many[np.minimum(at, len(place) - 1)], 0)
        place = place[near >= 2]
        of = np.searchsorted(self.begin, place + self.longest, "right") - 1
        return of, place - self.begin[of]

    def along(self, item: np.ndarray, of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which words of the item agree with each candidate's document if the item began at its place."""
        at = place[:, None] + np.arange(len(item))
        inside = (at >= 0) & (at < (self.first[of + 1] - self.first[of])[:, None])
        found = self.words[np.where(inside, at + self.first[of][:, None], 0)] if len(self.words) else np.full(at.shape, -1)
        return inside & (found == item)

    def document(self, n: int) -> np.ndarray:
        return self.words[self.first[n] : self.first[n + 1]]


def _search(items: list[tuple[int, list[int]]], frequency: dict[int, int], least: int, block: int, altered: float, shard_words: int):
    """The ``mapInArrow`` function that finds `items` (id, codes) in documents, given how often each code occurs in the corpus."""
    terms = np.unique(np.array([c for _, codes in items for c in codes], np.int32))
    number = {c: k for k, c in enumerate(terms.tolist())}
    coded = [(n, [number[c] for c in codes]) for n, codes in items]
    rank = np.empty(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=lambda k: (frequency.get(int(terms[k]), 0), int(terms[k])))] = np.arange(len(terms))
    longest = max((len(item) for _, item in coded), default=0)

    def find(keys: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
        index, out = Index(np.where(terms[at] == codes, at, -1), lengths, longest, rank), []
        texts: dict[int, list[int]] = {}
        for item_id, item in coded:
            best: dict[int, tuple[int, int, int]] = {}
            done: set[tuple[int, int]] = set()
            array, dense = np.array(item, np.int64), math.ceil(least * 0.45)
            of, places = index.places(item, block)
            some = max(1, 500_000 // max(len(item), 1))
            for k in range(0, len(of), some):  # candidates are held against their documents some at a time
                docs, at = of[k : k + some], places[k : k + some]
                same = index.along(array, docs, at)
                # A passage has a stretch of this diagonal (of `least` words, or half of it where a split word
                # moves the rest to the next one) on which nearly half of the words agree, two in a row.
                total = np.cumsum(np.c_[np.zeros(len(at), np.int32), same], axis=1, dtype=np.int32)
                most = (total[:, least:] - total[:, :-least]).max(axis=1) if len(item) >= least else total[:, -1]
                pairs = same[:, :-1] & same[:, 1:]
                for row in np.flatnonzero((most >= dense) & pairs.any(axis=1)).tolist():
                    n, place = int(docs[row]), int(at[row])
                    words = texts.get(n)
                    if words is None:
                        words = texts[n] = index.document(n).tolist()
                    for i in np.flatnonzero(pairs[row]).tolist():
                        if (n, place + i) in done:
                            continue
                        lo, hi, changed = follow(item, words, i, place + i)
                        done.update((n, place + j) for j in range(lo, hi + 1))
                        part = longest_part(lo, hi, changed, least, altered)
                        if part and part[0] > best.get(n, (0,))[0]:
                            best[n] = part
            out += [(item_id, int(keys[n]), *found) for n, found in best.items()]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], ["item_id", "doc_id", "words", "item_from", "altered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settle() -> pa.RecordBatch:
            lists = pa.concat_arrays([b.column(1) for b in held])
            keys = pa.concat_arrays([b.column(0) for b in held]).to_numpy()
            held.clear()
            return find(keys, lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64))

        for batch in batches:
            if len(terms) and batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())
            if size >= shard_words:
                yield settle()
                size = 0
        if held:
            yield settle()

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 24, block: int = 6, altered: float = 0.115, shard_words: int = 2_000_000, items_per_pass: int = 4_000, chars_per_pass: int = 20_000_000) -> DataFrame:
    """Rows ``item_id, doc_id, words, item_from, altered``: each document with a passage of an item.

    A passage is at least `least` words in a row of the item's text, single altered words included; of
    several in one document the longest is given. NULL, empty and blank texts hold no passage; items of
    fewer than `least` words cannot be found. Texts are read whole. Repeated documents each have their own
    row. Extra columns are ignored; empty tables give an empty result.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-sizes["n"] // items_per_pass), -(-sizes["chars"] // chars_per_pass))
    corpus = cut(code_documents(spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")), least))
    counted = corpus.where("doc_id is null").select(F.inline(F.arrays_zip("codes", "many"))).groupBy("codes").agg(F.sum("many").alias("many"))
    schema = "item_id bigint, doc_id bigint, words bigint, item_from bigint, altered bigint"
    codes, found = _Codes(), None
    for n in range(passes):
        block_of = [(r.item_id, [codes[w] for w in words_of(r.text)]) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect()]
        terms = documents.sparkSession.createDataFrame([(c,) for c in sorted({c for _, cs in block_of for c in cs})], "codes int")
        frequency = {r.codes: r.many for r in counted.join(terms, "codes", "left_semi").collect()}  # of the terms of this block of items
        part = corpus.where("doc_id is not null").select("doc_id", "codes").mapInArrow(_search(block_of, frequency, least, block, altered, shard_words), schema)
        if passes > 1:
            part = cut(part)  # so that the next block takes this one's place in the driver
        found = part if found is None else found.unionByName(part)
    return found
