import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from duskwatch.llm import bpe, packing, tables, token_counts
from duskwatch.llm.bpe import Merges, Vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, length int, sequence_id string, n_tokens string"

TEXTS = [
    None, "", " \n\t", "One two, two one!", "İstanbul ßtraße ŉ ﬁx e\u0301 naïve 12345 $$$ 's don't WE'LL",
    "<|endoftext|> a<|startoftext|>b <|x|>", "zero\u200bwidth\x1cand\u00a0blank\u3000wide \u1680", "漢字かな 한국 😀👨‍👩‍👧",
    "a" * 3000, "word " * 9000, "tab\tand\x0bmore\x0c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, None, None), (None, "no id", None, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_as_the_library(docs, library):
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), len(ids_of(library, r["text"]))) for r in docs.collect()
    ]
    assert got == sorted(want, key=str)


def test_random_texts(library):
    rng = random.Random(5)
    letters = [chr(c) for a, b in ((9, 0x250), (0x300, 0x530), (0x1E00, 0x2070), (0x3000, 0x30FF)) for c in range(a, b)]
    parts = ["<|endoftext|>", "'s", "'LL", " ", "\n", "don't", "É", "ß", "123", "<|"]
    texts = ["".join(rng.choice(parts if rng.random() < 0.3 else letters) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    words = Vocabulary(PATH)
    want = [ids_of(library, t) for t in texts]
    assert words.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [i.tolist() for i in words.ids(pa.array(texts))] == want


def test_merging_takes_the_lowest_rank_first():
    merges = Merges([("b", "c"), ("a", "b"), ("a", "bc"), ("a", "a")])
    number = merges.number
    assert merges.left([number(c) for c in "abc"]) == 1
    assert merges.left([number(c) for c in "aaaa"]) == 2
    assert merges.left([number(c) for c in "xyz"]) == 3
    assert merges.left([number("a")]) == 1


def test_over_limit(docs):
    told = token_counts.with_limit(token_counts.count_tokens(docs, PATH), 2048).where("over_limit").collect()
    assert [r["doc_id"] for r in told] == [9]


def test_packing_loses_nothing(docs, library):
    packed = packing.pack_documents(docs.withColumnRenamed("length", "offset"), PATH, 2, capacity=64, group_pieces=4).toPandas()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(len(ids_of(library, r["text"])) + 1)
    got = packed.fillna({"doc_id": -1}).groupby("doc_id")["length"].sum().to_dict()
    assert got == {k: sum(v) for k, v in want.items()}
    for _, seq in packed.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]]
        assert seq["length"].sum() <= 64


def test_pieces_carry_the_ids(docs, library):
    import zlib

    for r in packing.cut_documents(docs, PATH, 2, capacity=100).where("doc_id = 9").collect():
        ids = [*ids_of(library, TEXTS[9]), 2]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(part.tobytes()))


def test_first_fit_decreasing_as_a_plain_loop():
    rng = random.Random(3)
    for capacity in (7, 64):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        bins, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths, capacity) == [want[i] for i in range(len(lengths))]


def test_padding_is_small_and_powers_of_two_have_none(spark):
    lengths = spark.createDataFrame([(i, 1 + i * 7919 % 4096) for i in range(5000)], "id bigint, length bigint")
    told = packing.sequences(packing.pack(lengths)).toPandas()
    assert told["padding"].sum() / told["tokens"].sum() < 0.02
    assert told[told["tokens"].isin([2**k for k in range(13)])]["padding"].sum() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert packing.pack_documents(none, PATH, 2).count() == 0


class Spy:
    """The library, with the words that each call encodes counted."""

    def __init__(self, library):
        self.library, self.words = library, []

    def encode_batch_fast(self, texts, **options):
        self.words.append(sum(len(t.split()) for t in texts))
        return self.library.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_new_words_are_encoded_a_few_at_a_time(library, monkeypatch):
    monkeypatch.setattr(bpe, "LEARNED", 50, raising=False)
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(501))
    words = Vocabulary(PATH)
    spy = words.library = Spy(words.library)
    assert words.ids(pa.array([text, ""]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(spy.words) <= 50


def test_a_worker_hands_memory_back_when_another_operator_begins(monkeypatch):
    monkeypatch.setattr(tables, "_held", {})
    monkeypatch.setattr(tables, "_served", [None], raising=False)
    calls = []
    monkeypatch.setattr(tables.gc, "collect", lambda: calls.append(1))
    tables.let_go()
    assert not calls
    tables.let_go(but="x")
    assert len(calls) == 1
    tables.held("x", None, dict)
    seen = len(calls)
    tables.let_go(but="x")
    assert seen > 1 and len(calls) == seen
