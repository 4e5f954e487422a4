"""Operators tagged llm: brute force, round trips, held-out cases, edge cases."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from pelagia.llm import languages, leaks, nearest, quantiles, tokens
from pelagia.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def test_nearest_against_brute_force(spark):
    random.seed(2)
    have = [(random.choice("ab"), random.randrange(0, 40_000), k) for k in range(3000)] + [("a", 777, 5000), ("a", 777, 4999), (None, 1, 6000), ("a", None, 6001)]
    want = [(random.choice("abc"), random.randrange(-300, 40_500), k) for k in range(400)] + [(None, 5, 900), ("a", None, 901), ("a", 777, 902)]
    schema = "entity string, t_us bigint, rid bigint, cell string"
    a, b = (spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (want, have))
    got = {r.query_id: r.found_id for r in nearest.nearest_in_time(a, b, 30, cell_us=1000, error=2).collect()}
    truth = {}
    for e, t, k in want:
        near = [(abs(t2 - t), t2, k2) for e2, t2, k2 in have if e is not None and t is not None and e2 == e and t2 is not None and abs(t2 - t) <= 30]
        if near:
            truth[k] = min(near)[2]
    assert got == truth
    assert nearest.nearest_in_time(a, b.where("false"), 30, cell_us=1000).count() == 0


def test_pieces_keep_their_error():
    rng = np.random.default_rng(0)
    key = np.unique(np.cumsum(rng.integers(1, 10 ** rng.integers(1, 6, 5000))))
    lo, hi = nearest.fit_pieces(key, np.array([0, 1, 1000]), 4)
    assert lo[0] == 0 and hi[-1] == len(key) - 1 and np.all(lo[1:] == hi[:-1] + 1) and {0, 1, 1000} <= set(lo.tolist())
    for a, b in zip(lo, hi):
        at = np.arange(a, b + 1)
        assert np.max(np.abs(a + (key[at] - key[a]) * ((b - a) / max(key[b] - key[a], 1)) - at)) <= 4


@pytest.mark.parametrize("shape", ["normal", "ties", "few"])
def test_quantile_error_is_bounded(shape):
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=rng.integers(1, 4000)) * 10 for _ in range(40)]
    if shape == "ties":
        parts = [np.round(p) for p in parts]
    if shape == "few":
        parts = [p[:2] for p in parts]
    level = [quantiles.from_values(p, 200) for p in parts]
    while len(level) > 1:
        level = [quantiles.merge(level[k : k + 4], 200) for k in range(0, len(level), 4)]
    s, x = level[0], np.sort(np.concatenate(parts))
    assert s[3] == len(x) and len(s[0]) <= 203
    for v, lo, hi in zip(*s[:3]):
        assert np.searchsorted(x, v) + 1 <= hi and lo <= np.searchsorted(x, v, "right")
    for p in (0, 0.05, 0.5, 0.95, 1):
        v, off = quantiles.quantile(s, p)
        want = 1 + p * (len(x) - 1)
        assert np.searchsorted(x, v) + 1 - off <= want <= np.searchsorted(x, v, "right") + off
        assert off <= 0.02 * len(x) + 1


def test_percentiles_of_groups(spark):
    rows = [("a", float(k)) for k in range(1001)] + [("a", None), ("a", float("nan")), ("b", 5.0), (None, 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    s = quantiles.combine(quantiles.summarise(df, ["g"], "x"), ["g"], fan_in=2)
    got = {r.g: (r.n, r.mid) for r in quantiles.percentiles(s, ["g"], {"mid": 0.5}).collect()}
    assert got == {"a": (1001, 500.0), "b": (1, 5.0), None: (1, 1.0)}
    assert quantiles.combine(quantiles.summarise(df.where("false"), ["g"], "x"), ["g"]).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    random.seed(1)
    alphabet = "ab cde  \n\t'sst're.!?19éñ漢🙂​\u0085\x1c-_<|endoftext|> aaaa"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 70))) for _ in range(1500)] + ["", "   ", "a" * 3000, " " * 999 + "x", "<|endoftext|>", "é" * 500, "Hello world. " * 800]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)] + [(-1, None, 7), (0, texts[0], 7)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, VOCABULARY).collect()}
    assert got.pop(-1) == []
    encoder = tokens.Encoder(VOCABULARY)
    for k, t in enumerate(texts):
        assert got[k] == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert encoder.automaton.decode(got[k]).decode("utf-8") == t
    assert tokens.encode_corpus(df, VOCABULARY).count() == len(texts) + 2


def test_automaton_of_equal_parts():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258, b"aab": 259}
    a = tokens.Automaton(ranks)

    def merged(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min((ranks.get(x + y, 1 << 30), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (1 << 30, 0)
            if best[0] == 1 << 30:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    random.seed(0)
    for _ in range(400):
        word = bytes(random.choice(b"aab") for _ in range(random.randint(1, 14)))
        assert a.encode(word) == merged(word), word


WORDS = ["harbour", "budget", "school", "river", "minister", "the", "of", "to", "review", "cannot", "accept", "closure", "annual", "report", "bridge", "and", "in", "flats", "rented", "pension"]


def passage(n):
    return [random.choice(WORDS) + (random.choice("xyz") if random.random() < 0.3 else "") for _ in range(n)]


def test_leaks(spark):
    random.seed(8)
    items = [(k, " ".join(passage(100))) for k in range(12)] + [(98, None), (99, "too short")]
    documents, truth = [], set()
    for d in range(200):
        text = passage(150)
        if d % 4 == 0:
            k, n = random.randrange(12), random.choice([10, 18, 30, 60])
            at = random.randrange(0, 100 - n)
            part = items[k][1].split()[at : at + n]
            if n >= 30:
                for j in range(9, n - 5, 12):
                    part[j] = part[j][::-1] + "q"  # single altered words
                truth.add((k, d))
            part = " ".join(part).upper().replace(" ", ", ", 1).replace(" OF ", " (Applause in\nthe room) OF ").replace("BUDGET", "BUD-\nGET").replace("SCHOOL", "SCHÓOL")
            text = [*text[:60], part, *text[60:]]
        documents.append((d, " ".join(text), 1))
    documents += [(500, None, 1), (501, "", 1), (502, "   ", 1), (503, documents[0][1], 1)] + [(504, " ".join(passage(60_000)), 1)]
    if (pair := next((t for t in truth if t[1] == 0), None)) is not None:
        truth.add((pair[0], 503))
    df = spark.createDataFrame(documents, "doc_id bigint, text string, item_id int").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for per_pass in (4000, 5):
        found = leaks.leaked_passages(df, asked, items_per_pass=per_pass)
        assert {(r.item_id, r.doc_id) for r in found.collect()} == truth
    assert leaks.leaked_passages(df.where("false"), asked).count() == 0
    assert leaks.leaked_passages(df, asked.where("false")).count() == 0


def test_leaks_of_long_items(spark):
    item = [f"w{k}" for k in range(5000)]
    docs = spark.createDataFrame([(1, "x y z"), (2, " ".join(f"o{k}" for k in range(60))), (3, " ".join(item[4000:4060]))], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaked_passages(docs, items).collect()] == [(1, 3, 60, 4000, 0)]


def test_leaks_in_part_of_a_stretch():
    item = list(range(60))
    doc = [-1 if k >= 30 and k % 4 == 1 else k for k in item]  # 30 exact words, then every fourth is altered
    for i in (10, 58):
        lo, hi, changed = leaks.follow(item, doc, i, i)
        assert (lo, hi, len(changed)) == (0, 59, 7)
        length, begin, n = leaks.longest_part(lo, hi, changed, 24, 0.1)
        assert (length, begin, n) == (53, 0, 5) and n == sum(doc[k] < 0 for k in range(begin, begin + length))
    assert leaks.longest_part(0, 59, [(k, k + 1) for k in range(5, 55, 5)], 24, 0.115) is None


def test_words_of():
    assert leaks.words_of("Crème-brûlée (Lachen\nlinks) déjà-\nvu, 20.8 ｆｕｌｌ") == ["cremebrulee", "dejavu", "20", "8", "full"]
    assert leaks.words_of(None) == [] and leaks.words_of("((a) b) c") == ["c"]


TEXTS = {
    "en": "the town must explain the emergency budget and the school board has finally published the report of the working party",
    "de": "die stadt muss den nothaushalt erklären und der schulrat hat endlich den bericht der arbeitsgruppe über die brücken veröffentlicht",
    "fr": "la ville doit expliquer le budget de secours et le conseil scolaire a enfin publié le rapport du groupe de travail sur les ponts",
    "es": "la ciudad debe explicar el presupuesto de emergencia y el consejo escolar ha publicado por fin el informe del grupo de trabajo",
}


def test_languages(spark):
    random.seed(6)

    def text(code, n=40):
        return " ".join(random.choice(TEXTS[code].split()) for _ in range(n)).capitalize() + "."

    rows, truth = [], set()
    for k in range(240):
        code = random.choice(list(TEXTS))
        label = {0: None, 1: "xx", 2: random.choice([c for c in TEXTS if c != code]), 3: code.upper(), 4: languages.LANGUAGES[code][0]}.get(k % 12, code)
        parts = [text(code), text(code)]
        if k % 12 in (0, 1, 2):
            truth.add((k, 0, code))
        if k % 20 == 7:
            other = random.choice([c for c in TEXTS if c != code])
            parts.insert(1, text(other, 15))
            truth.add((k, 2, other))
        rows.append((k, "\r\n \r\n".join(parts), label, "x"))
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (902, " \n\n ", None, "x"), (903, "Hm?", None, "x"), (904, "123 456 789 10 11 12 13 14 15", None, "x")]
    rows.append((905, TEXTS["de"].upper() * 300, "de", "x"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, main string")
    assert {tuple(r) for r in languages.wrong_labels(df).collect()} == truth
    every = languages.assign_languages(df)
    assert every.where("confidence < 0.9 and para_no = 0 and words >= 8").count() == 0
    assert languages.wrong_labels(df.where("false")).count() == 0
    assert languages.wrong_labels(df.where("lang is null")).count() == 0


def test_labels_and_paragraphs():
    assert [languages.named_language(x) for x in ("en-GB", "German", "POR", "sv_SE", "und", "", None, "zz")] == ["en", "de", "pt", "sv", None, None, None, None]
    assert languages.paragraphs("\n\na\nb\n \t\n\nc\r\n\r\nd  ") == ["a\nb", "c", "d"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    from pelagia.llm import queries

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def _found(items, documents, **more):
    """Pairs that the search finds among lists of words, without a session."""
    from collections import Counter

    codes = leaks._Codes()
    coded = [(k, [codes[w] for w in ws]) for k, ws in items]
    frequency = Counter(codes[w] for ws in documents for w in ws)
    lists = pa.array([[codes[w] for w in ws] for ws in documents], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(documents)), pa.int64()), lists], ["doc_id", "codes"])
    run = leaks._search(coded, frequency, 24, 6, more.get("altered", 0.115), 2_000_000)
    return {(r["item_id"], r["doc_id"]) for b in run(iter([batch])) for r in b.to_pylist()}


@pytest.mark.parametrize(("length", "changes"), [(24, 0), (24, 1), (24, 2), (30, 2), (30, 3)])
def test_leak_recall_on_short_passages(length, changes):
    rng = np.random.default_rng(length * 10 + changes)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    weights = 1 / np.arange(1, 20_001)
    draw = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [(k, draw(120)) for k in range(200)]
    documents, truth = [], set()
    for d in range(200):
        at = int(rng.integers(0, 120 - length))
        part = list(items[d][1][at : at + length])
        inner = rng.choice(np.arange(1, (length - 2) // 2), changes, replace=False) * 2  # single: never two side by side, nor at an end
        for j in inner:
            part[j] = f"changed{d}x{j}"
        documents.append([*draw(150), *part, *draw(150)])
        truth.add((d, d))
    got = _found(items, documents)
    assert len(got & truth) >= 0.99 * len(truth) and got <= truth


def test_leaks_anywhere_in_a_very_long_item():
    item = [f"w{k}" for k in range(10_000)]
    documents = [[*(f"o{k}" for k in range(d)), *item[at : at + 40]] for d, at in enumerate(range(0, 9_960, 498))]
    assert len(documents) == 20 and _found([(1, item)], documents) == {(1, d) for d in range(20)}


def test_leaks_do_not_depend_on_the_split(spark):
    random.seed(12)
    items = [(k, " ".join(passage(90))) for k in range(10)]
    documents = [(d, " ".join([*passage(80), *items[d % 10][1].split()[20 : 20 + 20 + d % 30], *passage(40)])) for d in range(150)]
    df, asked = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = [{tuple(r) for r in leaks.leaked_passages(df.repartition(n), asked, shard_words=w).collect()} for n, w in ((1, 2_000_000), (7, 2_000_000), (16, 500))]
    assert rows[0] and rows[0] == rows[1] == rows[2]


def test_summaries_merge_in_a_tower_and_in_linear_time():
    rng = np.random.default_rng(1)
    values = [rng.normal(size=500) for _ in range(700)]
    tower = quantiles._Tower(200, 8)
    for v in values:
        tower.add(quantiles.from_values(v, 200))
    top, everything = tower.top(), np.sort(np.concatenate(values))
    assert top[3] == len(everything) and len(top[0]) <= 203
    for p in (0.01, 0.25, 0.5, 0.99):
        value, off = quantiles.quantile(top, p)
        rank = np.searchsorted(everything, value, "right")
        assert abs(rank - (1 + p * (len(everything) - 1))) <= off + 1 and off < 0.03 * len(everything)
    ties = quantiles.merge([quantiles.from_values(np.array([1.0, 2.0, 2.0]), 10), quantiles.from_values(np.array([2.0, 3.0]), 10)], 10)
    assert ties[1].tolist() == ties[2].tolist() == [1, 2, 3, 4, 5]


def test_token_table_is_bounded():
    a = tokens.Automaton({bytes([k]): k for k in range(256)} | {b"ab": 256, b"abc": 257}, most=50)
    for n in range(40):
        word = bytes((n * 7 + k * k) % 256 for k in range(90))
        assert a.decode(a.encode(word)) == word and len(a.table) <= 50
