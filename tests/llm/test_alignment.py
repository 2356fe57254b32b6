"""Token alignment against the plain intersection of all ends, and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from spendlight.llm import alignment
from spendlight.llm.tables import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, "One line <|endoftext|> here"), (3, "One line <|endoftext|> here"), (None, "no id </s>"), (4, " "), (5, "\n\n \t\n"), (6, "=" * 501 + "▁x"),
    (7, "中文 日本語 ไทย עברית 😀😀 é ﬁ ½"), (8, "\x00\x01 \x85   <0x41> <unk>"), (9, "word " * 100000 + "x" * 5000), (10, "a  b   c    d "), (11, "x" + " " * 1_200_000 + "y" + "\n " * 30_000),
]


@pytest.fixture(scope="module")
def plain():
    """Each tokenizer's ids and the bytes of each, one text after the other."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()

    def tokens(text):
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        data = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == data == b"".join(x for _, x in two) else ([], [])

    return tokens


def expected(rows, tokens):
    parts, counts = [], Counter()
    for doc_id, text in rows:
        one, two = tokens(text)
        ends = [np.cumsum([len(x) for _, x in side], dtype=int).tolist() for side in (one, two)]
        groups, links, at = [], [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(end, at[0]) + 1, ends[1].index(end, at[1]) + 1
            groups.append(",".join(str(i) for i, _ in one[at[0] : to[0]]) + "|" + ",".join(str(i) for i, _ in two[at[1] : to[1]]))
            links.append((one[to[0] - 1][0], two[to[1] - 1][0]))
            at = to
        counts.update(links)
        parts.append((doc_id, len(one), len(two), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((d, na, nb, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, k in parts),
        key=repr,
    )


def found(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def made(spark, rows, folder):
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA).withColumn("links", F.lit(1)).withColumn("a b", F.lit(2)).write.parquet(f"{folder}/documents.parquet")
    return found(alignment.op11_cross_tokenizer_alignment(spark, str(folder)))


def test_alignment_against_all_ends(spark, plain):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert found(alignment.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")) == expected(rows, plain)


def test_alignment_on_odd_rows(spark, plain, tmp_path):
    got = made(spark, ODD, tmp_path / "odd")
    assert got == expected(ODD, plain)
    assert (1, 0, 0, 0, 0, 0, 0, "") in got
    assert made(spark, [], tmp_path / "none") == []


def test_random_texts(spark, plain, tmp_path):
    rng = random.Random(5)
    pool = "ab zT,.'\n\t  =-_09éßü中文ไ😀́ <>|s/"
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 120)))) for i in range(500)]
    assert made(spark, rows, tmp_path / "random") == expected(rows, plain)


def test_long_texts_in_parts():
    known = alignment.Tokenizers()
    text = " ".join(random.Random(1).choice(["word", "\n", "three's", "=", "", "é", "42"]) for _ in range(3000))
    whole, parts = known.encode([text, "b"], 1 << 30), known.encode([text, "b"], 50)
    assert all((a == b).all() for one, two in zip(whole, parts, strict=True) for a, b in zip(one, two, strict=True))
    # a part may begin at any blank that follows a letter: no token goes over one
    for name in known.b_bytes:
        assert b" " not in name.lstrip(b" ")


@pytest.mark.parametrize("shared", [0.02, 0.3, 1.0])
def test_cuts_of_long_intervals(shared):
    rng = np.random.default_rng(3)
    every = np.arange(1, 40001)
    a, b = (np.flatnonzero((rng.random(40000) < 0.4) & ((every % 7 == side) | (rng.random(40000) < shared))) + 1 for side in (0, 1))
    a, b = np.union1d(a, [40000]), np.union1d(b, [40000])
    a_cut, b_cut = alignment.shared_cuts(a, b, *(np.array([x]) for x in (0, len(a), 0, len(b))))
    assert (a[a_cut] == np.intersect1d(a, b)).all() and (b[b_cut] == np.intersect1d(a, b)).all()
