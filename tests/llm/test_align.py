"""Alignment of two public tokenizers against token spans worked out one by one."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tideframe.llm import align, queries
from tideframe.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = [
    "the", "  ", "   ", " ", "\n", " \n", "ﬁ", "é", "x ", "\x1c ", "\u0085 ", " ", "　", "<s>", "<|endoftext|>", "日本語", "\x00", "😀", " word", "Ünï", "don't", "123", "\t", "a" * 40,
    " ", "hello", "\r", "<0x41>", "ſ", "​", "é", "͸", "\U0001e030",
]


def by_hand(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte, token = {c: k for k, c in enumerate(byte_alphabet())}, {k: t for t, k in a.get_vocab().items()}
    of_a = lambda i: bytes(byte[c] for c in token[i])

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, ids_a)) != whole or b"".join(map(of_b, ids_b)) != whole:
            docs.append((doc_id, None))
            continue
        ends_a, ends_b = (np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((of_a, ids_a), (of_b, ids_b)))
        spans = lambda ids, ends: list(zip(ids, [0, *ends], ends, strict=False))
        links = [(i, j) for i, s, e in spans(ids_a, ends_a) for j, t, f in spans(ids_b, ends_b) if max(s, t) < min(e, f)]
        cuts = sorted(set(ends_a) & set(ends_b))
        within = lambda ids, ends, s, e: ",".join(str(i) for i, x in zip(ids, ends, strict=True) if s < x <= e)
        groups = ";".join(f"{within(ids_a, ends_a, s, e)}|{within(ids_b, ends_b, s, e)}" for s, e in zip([0, *cuts], cuts, strict=False))
        count.update(links)
        docs.append((doc_id, (len(ids_a), len(ids_b), len(cuts), links, groups)))
    top = collections.defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return collections.Counter(
        (doc_id, *(zero if d is None else (*d[:3], len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]))) for doc_id, d in docs
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(1, 25)))) for k in range(250)]
    rows += [(300 + k, " ".join(rng.choice(["alpha", "beta", "gammas", "Dèlta", "x1", "réseau,"]) for _ in range(rng.randint(1, 40))) + rng.choice(["", " ", "\n", "."])) for k in range(100)]
    rows += [(400, "a▁b c"), (401, "▁"), (402, "c a▁ b")]  # shown as a space by one side
    return rows + [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None), (8, ""), (9, " "), (10, "  "), (11, "a "), (12, " a  "), (None, None)]


@pytest.mark.parametrize("most", [2000, 16_000_000])
def test_alignment(spark, rows, most):
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, pair int, block string").repartition(3)
    got = collections.Counter(map(tuple, align.align_documents(docs, A, B, most=most).collect()))
    assert got == by_hand(rows)
    assert align.align_documents(docs.limit(0), A, B).count() == 0


def test_parts_are_tokenized_as_the_whole(rows):
    tokens = align.load(A, B)
    for _, text in rows:
        for piece in (1, 5, 30, 1_000_000):
            parts = [p for ps in align.parts_of(text or "", True, piece) for p in ps]
            assert " ".join(parts) == (text or "")
            if parts:
                ids_a, _, ids_b, _, whole = tokens.encode(parts)
                if whole.all():
                    assert ids_a.tolist() == tokens.a.encode(" " + text, add_special_tokens=False).ids and ids_b.tolist() == tokens.b.encode(text)


def test_ranked_merging_of_plain_words_is_that_of_the_merge_list():
    rng = random.Random(6)
    words = {"".join(chr(rng.choice([rng.randint(33, 126), rng.randint(0xA1, 0x24F), rng.randint(97, 122)])) for _ in range(rng.randint(1, 30))) for _ in range(20_000)}
    words |= {"'s", "'S", "don't", "ll'll", "a" * 200, "ab" * 100}
    tokens, words = align.load(A, B), sorted(words)
    assert all(align._PLAIN.fullmatch(w) for w in words)
    assert tokens._encode_a(words) == [e.ids for e in tokens.a.encode_batch([" " + w for w in words], add_special_tokens=False)]


def test_bits():
    rng = np.random.default_rng(0)
    places = np.unique(rng.integers(0, 1000, 200))
    bits = align.Bits.of(places, 1000)
    at = np.arange(1001)
    assert (bits.rank(at) == (places[None, :] < at[:, None]).sum(axis=1)).all() and (bits.select() == places).all()


def test_long_text_is_taken_apart(spark):
    """A text of several pieces has the counts of its pieces' words; nothing depends on where a piece ends."""
    text = "alpha beta, gamma " * 150_000
    once = align.align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, digest=True).first()
    unit = align.align_documents(spark.createDataFrame([(1, "alpha beta, gamma")], "doc_id long, text string"), A, B).first()
    assert once["n_a"] == 150_000 * unit["n_a"] + 1 and once["n_groups"] == 150_000 * unit["n_groups"] + 1
    tokens = align.load(A, B)
    assert once["n_a"] == len(tokens.a.encode(" " + text, add_special_tokens=False).ids) and once["n_b"] == len(tokens.b.encode(text))


def test_query_hashes_the_groups(spark, tmp_path):
    rows = [(1, "hello world"), (2, ""), (3, "Grüße, world ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()}
    for row in by_hand(rows):
        r = got[row[0]]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) == row[1:7]
        assert r["groups_sha256"] == (hashlib.sha256(row[7].encode()).hexdigest() if row[7] else "")
