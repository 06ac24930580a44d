"""Groups, links and corpus-wide counts against plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortmill.llm import alignment
from cohortmill.llm.common import stored
from cohortmill.llm.queries import QUERIES, tokenizer_path

PATHS = (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def library():
    """Id lists by the library of the first tokenizer's own file, and by the second's."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment.byte_letters()
    names = {i: n for n, i in first.get_vocab().items()}

    def both(text):
        spelt = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        bytes_a = [bytes(letters[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                   else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != spelt or b"".join(bytes_b) != spelt:
            return [], []
        return [*zip(a, map(len, bytes_a))], [*zip(b, map(len, bytes_b))]
    return both


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by two pointers."""
    both, rows, links = library(), [], []
    for text in texts:
        a, b = both(text)
        groups, found, i, j, at_a, at_b = [([], [])], Counter(), 0, 0, 0, 0
        while i < len(a) and j < len(b):
            found[a[i][0], b[j][0]] += 1
            end_a, end_b = at_a + a[i][1], at_b + b[j][1]
            if end_a <= end_b:
                groups[-1][0].append(a[i][0])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(b[j][0])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        groups.pop()
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(spelt.encode()).hexdigest() if a else ""))
        links.append(found)
    counts = Counter(pair for found in links for pair in found)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, n_groups, sum(f.values()), sum(t for p, t in f.items() if counts[p] == most[p[0]]),
             sum(t * counts[p] for p, t in f.items()), digest) for (n_a, n_b, n_groups, digest), f in zip(rows, links)]


ODD = [None, "", " ", "  ", "▁x", "a" * 30000, "é漢字🎉" * 500, "<|endoftext|> <s> x</s>", "\n\n\t x\r\n", "x\x00y", "x​y", " 1 2  3", "same", "same",
       "naïve — “quoted” text’s", "=" * 5000 + "." + "-" * 5000]


def test_whole_table_equals_the_plain_form(spark):
    got = sorted(tuple(r) for r in QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((d.doc_id, *row) for d, row in zip(docs, plain([d.text for d in docs])))


@pytest.mark.parametrize("head", [0, 3, 1 << 20])
def test_odd_texts_and_any_head(spark, head):
    """Empty, odd and very long texts, repeated ids and null ids, clashing columns; the same counts
    whether all, some or no pairs are broadcast."""
    rows = [(None if n == 7 else n % 12, t, 1, "x") for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs string").repartition(3)
    aligned = stored(alignment.align(docs, *PATHS))
    out = alignment.link_statistics(aligned, head)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
            hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in out.collect()]
    want = [(d, *row) for (d, _, _, _), row in zip(rows, plain(ODD))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_statistics(stored(alignment.align(docs, *PATHS))).count() == 0


def test_leaves_wherever_the_cuts_lie():
    """Random ends, no shared end at all, and shared ends crowded at one side."""
    rng = np.random.default_rng(3)
    cases = [(np.unique(rng.integers(1, 400, n)), np.unique(rng.integers(1, 400, m)))
             for n, m in ((1, 1), (1, 50), (80, 90), (300, 20), (300, 300))]
    evens, odds = np.arange(2, 4000, 2), np.arange(1, 4000, 2)
    cases += [(evens, odds), (np.r_[np.arange(1, 200), evens + 200], np.r_[np.arange(1, 200), odds + 200])]
    for a, b in cases:
        a, b = np.r_[a, 9999], np.r_[b, 9999]
        leaves = alignment.leaf_groups(a, b, np.array([[0, len(a), 0, len(b)]]))
        shared = np.intersect1d(a, b)
        assert (a[leaves[:, 1] - 1] == shared).all() and (b[leaves[:, 3] - 1] == shared).all()
        assert (leaves[1:, [0, 2]] == leaves[:-1, [1, 3]]).all()
